"""Hashed token features of texts, for the linear classifiers.

A text is cut at white space. Every piece has a word (lower-cased, outer punctuation off) and a
shape (case, digits and the punctuation around). Pieces are hashed once per worker; n-grams are
combined from the hashes of whole batches in numpy.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np

from .common import claim

MEMO = 500_000
_CORE = re.compile(r"^(\W*)(.*?)(\W*)$", re.S)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_memo: dict[str, int] = {}


def _shape(lead: str, core: str, tail: str) -> str:
    if not core:
        kind = "-"
    elif core.isalpha():
        kind = "x" if core.islower() else "X" if core.isupper() and len(core) > 1 else "Xx" if core.istitle() else "c"
    else:
        kind = "9" if core.isdigit() else "z"
    return f"{lead[:3]}{kind}{tail[:3]}"


def piece_code(piece: str) -> int:
    """Word hash in the high half, shape hash in the low one."""
    lead, core, tail = _CORE.match(piece).groups()
    return crc32(core.lower().encode("utf-8", "surrogatepass")) << 32 | crc32(_shape(lead, core, tail).encode("utf-8", "surrogatepass"))


def codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(row of each piece, code of each piece)."""
    claim("features", _memo.clear)
    if len(_memo) > MEMO:
        _memo.clear()
    split = [(t or "").split() for t in texts]
    for p in set().union(*split) - _memo.keys():
        _memo[p] = piece_code(p)
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    get = _memo.__getitem__
    flat = np.fromiter((c for p in split for c in map(get, p)), np.uint64, int(sizes.sum()))
    return np.repeat(np.arange(len(split)), sizes), flat


def _mixed(*parts: np.ndarray | int) -> np.ndarray:
    h = np.uint64(0)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ np.uint64(p) if isinstance(p, int) else h ^ p) * _MIX
            h = h ^ (h >> np.uint64(29))
    return h


def features(texts: list[str | None], bits: int, kinds: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every n-gram, repeats included; features are below 2**bits.

    Kinds: w word, ww word pair, s shape, ss and sss shape n-grams, r a word equal to the one before.
    """
    row, code = codes(texts)
    word, shape = code >> np.uint64(32), code & np.uint64(0xFFFFFFFF)
    pair, triple = row[1:] == row[:-1], row[2:] == row[:-2]
    rows, made = [], []
    for kind in kinds:
        base = word if kind[0] in "wr" else shape
        if kind == "r":
            keep = pair & (word[1:] == word[:-1])
            rows.append(row[1:][keep])
            made.append(np.full(int(keep.sum()), _mixed(np.zeros(1, np.uint64), 5)[0]))
        elif len(kind) == 1:
            rows.append(row)
            made.append(_mixed(base, 1 + (kind == "s")))
        elif len(kind) == 2:
            rows.append(row[1:][pair])
            made.append(_mixed(base[:-1][pair], base[1:][pair], 3 + (kind == "ss")))
        else:
            rows.append(row[2:][triple])
            made.append(_mixed(base[:-2][triple], base[1:-1][triple], base[2:][triple], 7))
    return np.concatenate(rows), (np.concatenate(made) >> np.uint64(64 - bits)).astype(np.int64)


def indicators(row: np.ndarray, feature: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, feature) in order, and the number of times each occurs."""
    key, n = np.unique(row << bits | feature, return_counts=True)
    return key >> bits, key & ((1 << bits) - 1), n
