"""Byte-level BPE in batched numpy merge rounds.

All symbols of many distinct words lie in one flat array. A round finds the rank of every
adjacent pair by binary search over the sorted pair keys, takes the lowest rank in each word and
merges its occurrences from the left. Words without a pair left leave the array.

Null texts are empty: no tokens. Repeated rows each give a row; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import claim, map_text

#: Pieces a Python worker remembers before it starts anew.
MEMO = 600_000
# The white space class of the split pattern, spelled out because libraries differ on it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Bpe:
    """A vocabulary and its merges, with a memory of pieces already encoded."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        vocab, letters = data["model"]["vocab"], byte_letters()
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        size = max(*vocab.values(), *self.special.values()) + 1
        self.byte_id = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.byte_id[b] = vocab[letter]
        merges = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        left, right = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        made = np.array([vocab[m[0] + m[1]] for m in merges], np.int64)
        key = left * size + right
        order = np.argsort(key, kind="stable")
        self.size, self.keys, self.rank, self.made = size, key[order], order, made
        content = [b""] * size
        for token, i in vocab.items():
            content[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            content[i] = token.encode()
        self.text = _table(content)
        self.decimal = _table([b"%d," % i for i in range(size)])
        self.split = regex.compile(PATTERN)
        self.special_split = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.words: dict[str, bytes] = {}
        self.memo: dict[str, bytes] = {}

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of distinct byte strings, none empty."""
        n = len(words)
        sizes = np.fromiter(map(len, words), np.int64, n)
        symbol = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(n), sizes)
        done_word, done_symbol = [], []
        top = len(self.keys)
        while len(symbol):
            key = symbol[:-1] * self.size + symbol[1:]
            at = np.searchsorted(self.keys, key)
            at[at == top] = 0
            rank = np.full(len(symbol), top, np.int64)
            hit = np.flatnonzero((self.keys[at] == key) & (word[:-1] == word[1:])) if len(key) else np.zeros(0, np.int64)
            rank[hit] = self.rank[at[hit]]
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lengths = np.diff(np.r_[starts, len(word)])
            least = np.minimum.reduceat(rank, starts)
            ended = np.repeat(least == top, lengths)
            if ended.any():
                done_word.append(word[ended])
                done_symbol.append(symbol[ended])
            chosen = (rank == np.repeat(least, lengths)) & ~ended
            pos = np.flatnonzero(chosen)
            if len(pos):  # of adjacent occurrences, as in "aaa", every other one from the left
                run = np.flatnonzero(np.r_[True, np.diff(pos) != 1])
                parity = np.arange(len(pos)) - np.repeat(run, np.diff(np.r_[run, len(pos)]))
                pos = pos[parity % 2 == 0]
                symbol[pos] = self.made[rank[pos]]
            live = ~ended
            live[pos + 1] = False
            symbol, word = symbol[live], word[live]
        if not done_word:
            return []
        word, symbol = np.concatenate(done_word), np.concatenate(done_symbol)
        order = np.argsort(word, kind="stable")
        return np.split(symbol[order].astype("<u4"), np.cumsum(np.bincount(word, minlength=n))[:-1])

    def _learn(self, words: list[str]) -> None:
        known = self.words
        new = [w for w in dict.fromkeys(words) if w not in known]
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            for w, ids in zip(part, self.merge([w.encode("utf-8", "surrogatepass") for w in part])):
                known[w] = ids.tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian uint32.

        A text is cut at single spaces. A piece that begins and ends with other than white space is
        split the same way wherever it stands, so its ids are remembered under its own text with
        the space before it; other texts go through the split pattern whole.
        """
        if len(self.memo) > MEMO:
            self.memo.clear()
        if len(self.words) > MEMO:
            self.words.clear()
        plain, whole = [], []
        for i, t in enumerate(texts):
            t = t or ""
            if not t:
                continue
            if self.special_split is not None and self.special_split.search(t):
                whole.append((i, t))
                continue
            p = t.split(" ")
            p[1:] = [" " + x for x in p[1:]]
            plain.append((i, p))
        out = [b""] * len(texts)
        memo, find = self.memo, self.split.findall
        new = list(set().union(*(p for _, p in plain)) - memo.keys()) if plain else []
        split: dict[str, list[str]] = {}
        loose = set()
        for piece in new:
            body = piece[1:] if piece[:1] == " " else piece
            if not body or body[0].isspace() or body[-1].isspace():
                loose.add(piece)
            else:
                split[piece] = find(piece)
        self._learn([w for ws in split.values() for w in ws])
        words = self.words
        for piece, ws in split.items():
            memo[piece] = b"".join([words[w] for w in ws])
        for i, p in plain:
            if loose and not loose.isdisjoint(p) or any(x not in memo for x in (p[0], p[-1])):
                whole.append((i, texts[i]))
            else:
                out[i] = b"".join(map(memo.__getitem__, p))
        for i, t in whole:
            out[i] = self._encode_whole(t)
        return out

    def _encode_whole(self, text: str) -> bytes:
        out, at = [], 0
        spans = [(m.start(), m.end()) for m in self.special_split.finditer(text)] if self.special_split is not None else []
        for a, b in [*spans, (len(text), len(text))]:
            ws = self.split.findall(text[at:a])
            self._learn(ws)
            out += [self.words[w] for w in ws]
            if b > a:
                out.append(np.asarray([self.special[text[a:b]]], "<u4").tobytes())
            at = b
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        return _gather(self.text, ids)


def _table(content: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(c) for c in content], np.int64)
    return np.frombuffer(b"".join(content), np.uint8), np.cumsum(lengths) - lengths, lengths


def _gather(table: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray) -> bytes:
    blob, start, length = table
    size = length[ids]
    ends = np.cumsum(size)
    if not len(ends):
        return b""
    return blob[np.arange(ends[-1]) + np.repeat(start[ids] - ends + size, size)].tobytes()


_loaded: dict[int, Bpe] = {}


def loaded(spec: str) -> Bpe:
    """This worker's coder; it keeps its memory from task to task."""
    key = hash(spec)
    if key not in _loaded:
        _loaded[key] = Bpe(spec)
    claim("bpe", _loaded.clear)
    return _loaded[key]


def encode_decode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add n_tokens, ids (array of int) and decoded (the text from those ids)."""
    return _coded(docs, tokenizer_path, text_col, keep, [("n_tokens", "long"), ("ids", "array<int>"), ("decoded", "string")], lambda n, ids, text: (n, ids, text.decode("utf-8", "replace")))


def digests(docs: DataFrame, tokenizer_path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add n_tokens, ids_sha256 (of the decimal ids, comma-joined) and decoded_sha256."""
    return _coded(docs, tokenizer_path, text_col, keep, [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")], None)


def _coded(docs, tokenizer_path, text_col, keep, fields, shape):
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def start():
        coder = loaded(shared.value)

        def apply(texts):
            rows = []
            for data in coder.encode(texts):
                ids = np.frombuffer(data, "<u4").astype(np.int64)
                text = coder.decode(ids)
                if shape is None:
                    try:
                        text.decode()
                    except UnicodeDecodeError:
                        text = text.decode("utf-8", "replace").encode()
                    rows.append((len(ids), hashlib.sha256(_gather(coder.decimal, ids)[:-1]).hexdigest(), hashlib.sha256(text).hexdigest()))
                else:
                    rows.append(shape(len(ids), ids.tolist(), text))
            return list(zip(*rows)) if rows else [[]] * 3

        return apply

    return map_text(docs, text_col, fields, start, keep)
