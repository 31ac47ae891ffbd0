"""SimHash near-duplicates by anchor-point covering.

Anchors are the words of a covering code; a fingerprint is copied to every anchor within the
covering radius plus the threshold, so two fingerprints within the threshold always meet: the
anchor that covers one of them is within radius plus threshold of the other. Over all 64 bits
with threshold 3 any code of useful size needs thousands of copies, so the fingerprint is taken
as two halves first: of three differing bits one half has at most one. Each half, less its top
bit, is covered by the perfect Hamming code of length 31 (radius 1), which takes at most 16
copies for radius plus threshold 2.

Fingerprints of equal value are one node, whatever their number of documents. Within an anchor
links are found by a search from node to node that leaves out what it has reached, and only a
tree of links is written, never all pairs. Anchors that are frequent in a sample of fingerprints
are split: two fingerprints within the threshold are equal in one of four quarters of the half
that the anchor does not cover, so each is dealt by the values of these quarters. The sample
changes no result, only which groups are split.


Null and empty texts, and texts without a word, have fingerprint zero and link like any other.
Documents with a null id have a class like others; the class id is the least non-null id, null
where a class has none. Repeated rows each give a row. Texts of any length are read whole. Other
columns of the table may have any names. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import bounded_ids, discard, map_text, materialize
from .graph import components

SHINGLE = 3
SEED = 42
THRESHOLD = 3
#: Groups up to this size are compared by shifts, all at once.
SMALL = 24
#: Fingerprints of the sample that finds frequent anchors, and how many of these make one.
SAMPLE = 20_000
FREQUENT = 200
# Lower case of A-Z in bytes.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash: a bit is set if it is set in over half the shingle hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, stops[:-1] + 1]
    digest = xxhash.xxh64_intdigest
    at = zip(starts[:n].tolist(), stops[min(shingle, len(words)) - 1 :].tolist())
    h = np.fromiter([digest(joined[s:e], SEED) for s, e in at], np.uint64, n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 255 * 64):
        bits = np.unpackbits(h[i : i + 255 * 64].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        whole = len(bits) // 255 * 255
        counts += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.uint8)
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist()))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def start():
        return lambda texts: [[f - (1 << 64) if f >= 1 << 63 else f for f in map(fingerprint, texts)]]

    return map_text(source, "text", [("fp", "long")], start, ["doc_id"])


def _masks() -> np.ndarray:
    """For each syndrome the flips that lead to code words within distance 2; -1 pads."""
    table = np.full((32, 16), -1, np.int64)
    table[0, 0] = 0
    for s in range(1, 32):
        flips = [1 << (s - 1)] + [1 << (i - 1) | 1 << ((i ^ s) - 1) for i in range(1, 32) if i < i ^ s]
        table[s, : len(flips)] = flips
    return table


MASKS = _masks()
_CHECKS = [sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1) for k in range(5)]


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, anchor): every anchor it is copied to, of both halves."""
    rows, keys = [], []
    bits = fp.view(np.uint64)
    for half in (0, 1):
        x = (bits >> np.uint64(32 * half) & np.uint64(0x7FFFFFFF)).astype(np.int64)
        syndrome = np.zeros(len(x), np.int64)
        for k, check in enumerate(_CHECKS):
            syndrome |= (np.bitwise_count(x & check).astype(np.int64) & 1) << k
        flips = MASKS[syndrome]
        i, j = np.nonzero(flips >= 0)
        rows.append(i)
        keys.append((x[i] ^ flips[i, j]) | half << 31)
    return np.concatenate(rows), np.concatenate(keys)


def quarters(fp: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Four keys of each row below its anchor: the bytes of the half that the anchor does not cover."""
    other = fp.view(np.uint64) >> (np.uint64(32) * (1 - (anchor >> 31)).astype(np.uint64)) & np.uint64(0xFFFFFFFF)
    place = np.arange(4, dtype=np.uint64)
    key = place << np.uint64(8) | (other[:, None] >> (np.uint64(8) * place) & np.uint64(255))
    return (anchor[:, None] << 11 | (key.astype(np.int64) + 1)).reshape(-1)


def frequent_anchors(fps: DataFrame, sample: int = SAMPLE, least: int = FREQUENT) -> np.ndarray:
    """Anchors of at least `least` of the `sample` fingerprints of least hash, sorted."""
    drawn = bounded_ids(fps.select("fp"), "fp", sample).toArrow()["fp"].to_numpy()
    found, n = np.unique(anchors(drawn)[1], return_counts=True)
    return found[n >= least]


def link_group(fp: np.ndarray, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """A tree of links for each component of distinct fingerprints."""
    bits, left, out = fp.view(np.uint64), np.arange(len(fp)), []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            reached = []
            for x in front.tolist():
                near = np.bitwise_count(bits[left] ^ bits[x]) <= threshold
                if near.any():
                    found = left[near]
                    out.extend((int(fp[x]), int(fp[y])) for y in found)
                    reached.append(found)
                    left = left[~near]
            front = np.concatenate(reached) if reached else left[:0]
    return out


def links(fps: DataFrame, threshold: int = THRESHOLD, sample: int = SAMPLE, frequent: int = FREQUENT) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints within the threshold."""
    if not 0 <= threshold <= 3:
        raise ValueError("the two-half cover holds for thresholds up to 3")

    shared = fps.sparkSession.sparkContext.broadcast(frequent_anchors(fps, sample, frequent))

    def copy(batches):
        hot = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fp = batch.column(0).to_numpy()[at : at + 4096]
                i, keys = anchors(fp)
                split = np.isin(keys, hot) if len(hot) else np.zeros(len(keys), bool)
                keys = np.concatenate([keys[~split] << 11, quarters(fp[i[split]], keys[split])])
                rows = np.concatenate([fp[i[~split]], np.repeat(fp[i[split]], 4)])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(rows)], names=["anchor", "fp"])

    dealt = fps.select("fp").mapInArrow(copy, "anchor long, fp long").repartition("anchor").sortWithinPartitions("anchor")

    def compare(batches):
        rest_key, rest_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def groups(key, fp):
            if not len(key):
                return None
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[first, len(key)])
            us, vs = [], []
            small = np.repeat(size <= SMALL, size)
            widest = int(size[size <= SMALL].max(initial=1))
            for d in range(1, widest):
                same = (key[d:] == key[:-d]) & small[d:]
                i = np.flatnonzero(same)
                i = i[np.bitwise_count(fp[i].view(np.uint64) ^ fp[i + d].view(np.uint64)) <= threshold]
                us.append(fp[i])
                vs.append(fp[i + d])
            for f, n in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist()):
                if found := link_group(fp[f : f + n], threshold):
                    pairs = np.array(found, np.int64)
                    us.append(pairs[:, 0])
                    vs.append(pairs[:, 1])
            if not us:
                return None
            u, v = np.concatenate(us), np.concatenate(vs)
            pairs = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["u", "v"])

        for batch in batches:
            key, fp = np.r_[rest_key, batch.column(0).to_numpy()], np.r_[rest_fp, batch.column(1).to_numpy()]
            whole = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if (made := groups(key[:whole], fp[:whole])) is not None:
                yield made
            rest_key, rest_fp = key[whole:], fp[whole:]
        if (made := groups(rest_key, rest_fp)) is not None:
            yield made

    return dealt.mapInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of docs."""
    marked = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes, threshold))
    linked = roots.join(nodes.withColumnRenamed("fp", "node"), "node")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = materialize(roots.join(least, "root").select(F.col("node").alias("fp"), "component_id"), "classes")
    discard(roots)
    each = materialize(nodes.join(classes, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "classes")
    discard(nodes, classes)
    return marked.join(each, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
