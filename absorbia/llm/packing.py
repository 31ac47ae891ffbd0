"""Best-fit packing of token sequences by bin completion.

The packing problem is stated on the histogram of piece lengths, which has at most `capacity`
entries whatever the corpus size, so the branch and bound runs on the driver over bounded data.
Its answer, a list of (pattern, multiplicity), is turned into rank intervals per length, and the
pieces look their place up by their rank among pieces of equal length.

Nulls and empty texts are documents of one token (the end id). Repeated rows are packed once each,
whatever their ids; pieces of equal length, salt, id, place and content are interchangeable. Long
texts are cut into pieces of the capacity. Other columns of the table may have any names. An empty
table gives no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_right, insort
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .bpe import byte_letters
from .common import claim, materialize, pieces

CAPACITY = 4096
END_ID = 1
SALTS = 64
#: Nodes of the branch and bound over sequences; a fiftieth of them is the most for one filling.
NODES = 200_000
#: Words a Python worker remembers before it starts anew.
MEMO = 500_000
ODD = re.compile("[\x1c-\x1f]")

# The words of the tokenizer's split pattern, which it applies to lower-cased text.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Pieces of characters below this one, but for a final sigma none of them, need no normalising but lower case.
PLAIN = "\u0250"

_coders: dict[int, "Coder"] = {}


class Coder:
    """The tokenizer with a memory of pieces (between white space) and of words.

    The tokenizer drops white space and splits at it, so that pieces between white space are
    encoded independently. A piece of plain characters is lower-cased, split, and each new word
    given to the library's BPE model; others go through the library's whole chain.
    """

    def __init__(self, spec: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.special = [t["content"] for t in json.loads(spec)["added_tokens"]]
        self.letters = {b: letter for letter, b in byte_letters().items()}
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _learn(self, new: list[str]) -> None:
        words, tokenize, letters, find, later = self.words, self.tokenizer.model.tokenize, self.letters, WORDS.findall, []
        for piece in new:
            if not piece.isascii() and max(piece) >= PLAIN or "<|" in piece and any(x in piece for x in self.special):
                later.append(piece)
                continue
            out, low = [], piece.lower()
            for w in (low,) if low.isalpha() else find(low):  # letters alone are one word
                ids = words.get(w)
                if ids is None:
                    ids = words[w] = array("I", [t.id for t in tokenize(w.encode().decode("latin-1").translate(letters))]).tobytes()
                out.append(ids)
            self.pieces[piece] = b"".join(out)
        for at in range(0, len(later), 4096):
            part = later[at : at + 4096]
            for piece, got in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                self.pieces[piece] = np.asarray(got.ids, "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian uint32.

        Texts with the control characters on which Python's split and the library differ go to
        the library whole.
        """
        if len(self.pieces) > MEMO:
            self.pieces.clear()
        if len(self.words) > MEMO:
            self.words.clear()
        odd = {i for i, t in enumerate(texts) if t and ODD.search(t)}
        split = [() if i in odd else (t or "").split() for i, t in enumerate(texts)]
        self._learn(list(set().union(*split) - self.pieces.keys()))
        get = self.pieces.__getitem__
        out = [b"".join(map(get, p)) for p in split]
        for i in odd:
            out[i] = np.asarray(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, "<u4").tobytes()
        return out


def encode_texts(texts: list[str | None], spec: str) -> list[bytes]:
    """Ids by this worker's coder, which keeps its memory from task to task."""
    key = hash(spec)
    if key not in _coders:
        _coders[key] = Coder(spec)
    claim("packing", _coders.clear)
    return _coders[key].encode(texts)


def cut(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Token pieces of at most `capacity` ids: doc_id, piece, start, length, ids_crc32."""
    end = np.asarray([end_id], "<u4").tobytes()
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        for part in pieces(batches, "text"):
            rows = ([], [], [], [], [])
            for doc, ids in zip(part.column(0).to_pylist(), encode_texts(part.column(1).to_pylist(), shared.value)):
                ids = memoryview(ids + end)
                for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                    data = ids[4 * start : 4 * (start + capacity)]
                    for col, v in zip(rows, (doc, piece, start, len(data) // 4, zlib.crc32(data))):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return source.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def completion(room: int, count: dict[int, int], lengths: list[int], nodes: int = NODES // 50) -> tuple[int, ...]:
    """The undominated filling of `room` with least waste: fewer and longer items first.

    Iterative deepening over the number of items. A filling of fewer items dominates one whose
    items can be grouped into its own, so the first filling without waste is taken; a branch
    whose most possible filling does not beat the incumbent is pruned. The incumbent begins as
    the best-fit one.
    """
    best: tuple[int, ...] = ()
    left, at = room, bisect_right(lengths, room) - 1
    used: dict[int, int] = {}
    while left and at >= 0:  # best fit: the longest item that still fits, again and again
        item = lengths[at]
        take = min(left // item, count[item] - used.get(item, 0))
        if take > 0:
            best += (item,) * take
            left -= take * item
        at = min(at - 1, bisect_right(lengths, left) - 1)
    if left == 0 or not lengths:
        return best
    waste, budget = left, nodes

    def deepen(left: int, top: int, depth: int, chosen: tuple[int, ...]) -> bool:
        nonlocal best, waste, budget
        top = min(top, bisect_right(lengths, left) - 1)
        if depth == 1:
            for i in range(top, -1, -1):
                item = lengths[i]
                if chosen.count(item) < count[item]:
                    if left - item < waste:
                        best, waste = (*chosen, item), left - item
                    return waste == 0
            return False
        for i in range(top, -1, -1):
            item = lengths[i]
            if left - depth * item >= waste:  # even depth items of this length leave too much
                break
            budget -= 1
            if budget < 0:
                return False
            if chosen.count(item) < count[item] and deepen(left - item, i, depth - 1, (*chosen, item)):
                return True
        return False

    for depth in range(1, room // lengths[0] + 1):
        if deepen(room, len(lengths) - 1, depth, ()) or budget < 0:
            break
    return best


def plan(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in one bin) with multiplicities that use up the histogram.

    The first incumbents take the best completion around the longest remaining item, and the
    best-fit one, as often as the histogram allows. While they have more bins than the bound by
    total length and by items over half a bin, other fillings and multiplicities are tried depth
    first, within `nodes` nodes.
    """
    count = {k: v for k, v in histogram.items() if v > 0}
    total = sum(k * v for k, v in count.items())
    bound = max(-(-total // capacity), sum(v for k, v in count.items() if 2 * k > capacity))
    bins, best = _descend(count, capacity, nodes // 50)
    if bins > bound:
        bins, best = min((bins, best), _descend(count, capacity, 0), key=lambda x: x[0])
    return _search(count, capacity, total, bound, bins, best, nodes) if bins > bound else best


def _descend(histogram: dict[int, int], capacity: int, nodes: int) -> tuple[int, list[tuple[tuple[int, ...], int]]]:
    count, lengths, out = dict(histogram), sorted(histogram), []
    while lengths:
        first = lengths[-1]
        count[first] -= 1
        fill = completion(capacity - first, count, lengths, nodes)
        count[first] += 1
        pattern = (first, *sorted(fill, reverse=True))
        uses = {k: pattern.count(k) for k in set(pattern)}
        times = min(count[k] // n for k, n in uses.items())
        for k, n in uses.items():
            count[k] -= n * times
            if not count[k]:
                lengths.remove(k)
        out.append((pattern, times))
    return sum(m for _, m in out), out


def fillings(room: int, count: dict[int, int], lengths: list[int], step: Callable[[], bool]):
    """Undominated fillings, longest items first: nothing more fits, and no item could give way to
    a longer one that is left over. step() is false once the search has to stop."""

    def grow(left: int, top: int, chosen: tuple[int, ...]):
        if not step():
            return
        fits = False
        for i in range(min(top, bisect_right(lengths, left) - 1), -1, -1):
            item = lengths[i]
            if chosen.count(item) < count[item]:
                fits = True
                yield from grow(left - item, i, (*chosen, item))
        if fits:
            return
        for item in set(chosen):
            longer = bisect_right(lengths, item + left) - 1
            while longer >= 0 and lengths[longer] > item:
                if chosen.count(lengths[longer]) < count[lengths[longer]]:
                    return
                longer -= 1
        if not any(chosen.count(x) < count[x] for x in lengths[: bisect_right(lengths, left)]):
            yield chosen

    yield from grow(room, len(lengths) - 1, ())


def _search(histogram: dict[int, int], capacity: int, total: int, bound: int, bins: int, best: list, nodes: int) -> list[tuple[tuple[int, ...], int]]:
    """Bin completion with backtracking: a packing of fewer bins if one is found within the nodes."""
    count, lengths, budget = dict(histogram), sorted(histogram), nodes
    out: list[tuple[tuple[int, ...], int]] = []
    used = waste = 0

    def step() -> bool:
        nonlocal budget
        budget -= 1
        return budget >= 0

    def change(pattern: tuple[int, ...], times: int) -> None:
        for k in set(pattern):
            before = count[k]
            count[k] += pattern.count(k) * times
            if not before:
                insort(lengths, k)
            elif not count[k]:
                lengths.remove(k)

    def choices():
        first = lengths[-1]
        count[first] -= 1
        kept, left = dict(count), [k for k in lengths if count[k]]
        best_fit = tuple(sorted(completion(capacity - first, kept, left, min(nodes // 50, max(budget, 0))), reverse=True))
        count[first] += 1
        seen = set()
        for fill in chain([best_fit], fillings(capacity - first, kept, left, step)):
            pattern = (first, *fill)
            if pattern in seen:
                continue
            seen.add(pattern)
            for times in range(min(count[k] // pattern.count(k) for k in set(pattern)), 0, -1):
                if step() and waste + times * (capacity - sum(pattern)) <= (bins - 1) * capacity - total:
                    yield pattern, times

    stack = [choices()]
    while stack and budget > 0:
        choice = next(stack[-1], None)
        if choice is None:
            stack.pop()
            if out:
                pattern, times = out.pop()
                change(pattern, times)
                used, waste = used - times, waste - times * (capacity - sum(pattern))
            continue
        pattern, times = choice
        change(pattern, -times)
        out.append(choice)
        used, waste = used + times, waste + times * (capacity - sum(pattern))
        if not lengths and used < bins:
            bins, best = used, list(out)
            if bins == bound:
                break
        stack.append(choices() if lengths else iter(()))
    return best


def intervals(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each length its ranks in order: first rank, uses a sequence, first sequence, offset."""
    rows, next_rank, sequence = [], {}, 0
    for pattern, times in patterns:
        offset = 0
        for k in dict.fromkeys(pattern):
            n = pattern.count(k)
            rows.append((k, next_rank.get(k, 0), n, sequence, offset))
            next_rank[k] = next_rank.get(k, 0) + n * times
            offset += n * k
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return {"key": (table[:, 0] << 44) + table[:, 1], "rank": table[:, 1], "uses": table[:, 2], "sequence": table[:, 3], "offset": table[:, 4]}


def pack_pieces(cuts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces (a table that can be read again)."""
    salted = cuts.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int"))
    seen = salted.groupBy("length", "_salt").count().toArrow()  # at most capacity x SALTS rows
    counts = np.zeros((capacity + 1, SALTS), np.int64)
    counts[seen["length"].to_numpy(), seen["_salt"].to_numpy()] = seen["count"].to_numpy()
    start = np.cumsum(counts, axis=1) - counts
    totals = counts.sum(axis=1)
    places = intervals(plan({int(k): int(totals[k]) for k in np.flatnonzero(totals)}, capacity))
    shared = cuts.sparkSession.sparkContext.broadcast((start, places))
    # the salt keeps a length that many copies share from landing in one task
    dealt = salted.repartition("length", "_salt").sortWithinPartitions("length", "_salt", "doc_id", "piece", "ids_crc32")

    def run(batches):
        start, at = shared.value
        last, seen = -1, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            length, salt = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "_salt"))
            group = length * SALTS + salt
            new = np.r_[True, group[1:] != group[:-1]]
            first = np.flatnonzero(new)
            within = np.arange(len(group)) - np.repeat(first, np.diff(np.r_[first, len(group)]))
            if group[0] == last:
                within[: first[1] if len(first) > 1 else len(group)] += seen
            last, seen = group[-1], within[-1] + 1
            rank = start[length, salt] + within
            i = np.searchsorted(at["key"], (length << 44) + rank, side="right") - 1
            k = rank - at["rank"][i]
            sequence, offset = at["sequence"][i] + k // at["uses"][i], at["offset"][i] + (k % at["uses"][i]) * length
            keep = [j for j, c in enumerate(batch.schema.names) if c != "_salt"]
            yield pa.RecordBatch.from_arrays([*(batch.column(j) for j in keep), pa.array(sequence), pa.array(offset)], names=[*(batch.schema.names[j] for j in keep), "sequence_id", "offset"])

    return dealt.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenise documents, cut the long ones and pack the pieces into as few sequences as found.

    Rows: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    return pack_pieces(materialize(cut(docs, spec, id_col, text_col, capacity, end_id), "pieces"), capacity)
