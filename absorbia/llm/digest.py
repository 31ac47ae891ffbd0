"""Quartile bucket digests of byte triplets, and documents beside their edited neighbours.

Triplets of bytes within a window of five are hashed into 128 buckets. The digest holds for each
bucket in which quartile its count lies (two bits), the ratios of the quartiles and the logarithm
of the length; two digests differ by the sum of their bucket steps plus header terms, and
likeness is one minus that difference over a bound, not below 0. Equal texts have equal digests;
texts too short for a triplet have all buckets in the lowest quartile.

Null texts are empty. Rows of equal doc_id are ordered by their text's SHA-256; equal rows each
give a row. Texts of any length are digested whole, a part at a time. Other columns of the table
may have any names. A table of one row is its own neighbour; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import pieces

BUCKETS = 128
#: The difference at which likeness reaches 0.
BOUND = 160.0
#: Least documents in a block of neighbours.
BLOCK = 2048
_SKIPS = ((1, 2), (1, 3), (2, 3), (1, 4))


def digest(data: bytes) -> str:
    """The digest as hex: length byte, quartile ratio byte, then two bits a bucket."""
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(data), 1 << 20):
        b = np.frombuffer(data[at : at + (1 << 20) + 4], np.uint8).astype(np.uint32)
        for salt, (i, j) in enumerate(_SKIPS):
            n = min(len(b) - j, 1 << 20)
            if n > 0:
                h = (b[:n] << 16 | b[i : i + n] << 8 | b[j : j + n]) + np.uint32(salt * 0x1000003)
                h *= np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
                h *= np.uint32(0x85EBCA77)
                counts += np.bincount(h >> np.uint32(25), minlength=BUCKETS)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    code = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    quads = code.reshape(-1, 4)
    body = (quads[:, 0] << 6 | quads[:, 1] << 4 | quads[:, 2] << 2 | quads[:, 3]).astype(np.uint8)
    size = min(255, round(8 * math.log2(1 + len(data)))) if data else 0
    ratio = (int(16 * q1 // max(q3, 1)) & 15) << 4 | int(16 * q2 // max(q3, 1)) & 15
    return bytes([size, ratio]).hex() + body.tobytes().hex()


def difference(a: str, b: str) -> int:
    """0 for equal digests; each bucket adds its steps, or 6 for the full three."""
    x, y = bytes.fromhex(a), bytes.fromhex(b)
    length = abs(x[0] - y[0])
    head = min(length, 12) if length > 1 else length
    head += min(2, abs((x[1] >> 4) - (y[1] >> 4))) + min(2, abs((x[1] & 15) - (y[1] & 15)))
    u, v = (np.frombuffer(z[2:], np.uint8) for z in (x, y))
    steps = np.abs(np.stack([(u >> s & 3).astype(np.int8) - (v >> s & 3).astype(np.int8) for s in (0, 2, 4, 6)]))
    return head + int(np.where(steps == 3, 6, steps).sum())


def likeness(a: str, b: str) -> float:
    return max(0.0, 1.0 - difference(a, b) / BOUND)


def edited_text(text: str, following: str) -> str:
    """text with its last third replaced by the first as many code points of the next text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Each document with its digest, and those of its edited text and of its next document.

    The order is by descending doc_id, the first following the last. Documents are dealt into
    blocks of neighbouring ids, and the first document of a block also goes to the block before,
    so texts move once. A block has about max(block, sqrt(n)) of n documents, so that neither the
    blocks nor their number, which the driver holds the first ids of, grow faster than the square
    root. A task sorts its blocks, spilling where they are large, and holds one document at a time;
    rows of one id are one block.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = source.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    blocks = max(1, size // max(block, math.isqrt(size)))
    # nulls last in descending order
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    cuts = sorted(set(source.select(key.alias("k")).agg(F.percentile_approx("k", [i / blocks for i in range(1, blocks)] or [0.5], max(100_000, 20 * blocks)).alias("q")).first()["q"] or []), reverse=True) if blocks > 1 else []
    shared = docs.sparkSession.sparkContext.broadcast(np.array(cuts[::-1], np.int64))

    def deal(batches):
        """Block 0 has the largest ids; the ids of block i are above cut i."""
        cuts = shared.value
        for part in batches:
            ids = part.column(0).fill_null(-(2**63)).to_numpy()
            number = len(cuts) - np.searchsorted(cuts, ids, side="left")
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), part.column(0), part.column(1)], names=["block", "doc_id", "text"])

    tops = {r["block"]: r["top"] for r in source.select("doc_id").withColumn("text", F.lit("")).mapInArrow(deal, "block int, doc_id long, text string").groupBy("block").agg(F.max(F.coalesce("doc_id", F.lit(-(2**63)))).alias("top")).collect()}
    present = sorted(tops)
    before = {b: present[i - 1] for i, b in enumerate(present)}  # the last block takes the very first document
    heads = docs.sparkSession.sparkContext.broadcast(([(tops[b], before[b]) for b in present], shared.value))

    def deal_twice(batches):
        tops, cuts = heads.value
        goes = dict(tops)
        for part in pieces(batches, "text", 16 << 20, 100_000):
            ids = part.column(0).fill_null(-(2**63)).to_numpy()
            number = len(cuts) - np.searchsorted(cuts, ids, side="left")
            extra = [i for i, d in enumerate(ids.tolist()) if d in goes]
            at = np.r_[np.arange(len(ids)), np.array(extra, np.int64)].astype(np.int64)
            to = np.r_[number, np.array([goes[int(ids[i])] for i in extra], np.int64)].astype(np.int32)
            copy = np.r_[np.zeros(len(ids), bool), np.ones(len(extra), bool)]
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(copy), part.column(0).take(pa.array(at)), part.column(1).take(pa.array(at))], names=["block", "copied", "doc_id", "text"])

    dealt = source.mapInArrow(deal_twice, "block int, copied boolean, doc_id long, text string")
    order = ["block", "copied", F.desc_nulls_last("doc_id"), F.sha2("text", 256)]
    n = max(1, blocks)
    dealt = dealt.repartition(n, "block").sortWithinPartitions(*order)

    def run(batches):
        held = None  # (block, doc_id, text, digest): waits for its next document
        block, passed = None, False
        out = []

        def close(following: str, mark: str):
            _, doc, text, own = held
            edited = edited_text(text, following)
            data = edited.encode("utf-8", "surrogatepass")
            theirs = own if edited == text else digest(data)
            out.append((doc, len(text), hashlib.sha256(data).hexdigest(), own, theirs, likeness(own, theirs), likeness(own, mark)))

        for part in pieces(batches, "text", 8 << 20):
            for to, copied, doc, text in zip(*(c.to_pylist() for c in part.columns)):
                if to != block:
                    block, passed = to, False
                if copied and passed:
                    continue  # only the first of several copies is the next document
                mark = digest(text.encode("utf-8", "surrogatepass"))
                if held is not None:
                    close(text, mark)
                    held = None
                if copied:
                    passed = True
                else:
                    held = (to, doc, text, mark)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
                out = []

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
