"""Approximate nearest neighbours with hash-prefix forests.

A vector's hash string in a tree is a long run of bits, each the side of a plane midway between
two vectors of a bounded sample. Every block of index rows is held as sorted arrays of hash
strings, one a tree. A query descends each tree to its longest matching prefix, and then all
trees ascend together, a bit at a time, until the prefix ranges hold enough candidates; these are
compared exactly, in double precision.

Queries come in blocks of bounded size, one after another; each block passes over all index rows
once, and its answers are written before the next is drawn. Equal vectors in a block of rows are
one index entry with its least ids, so that no number of copies crowds out others.

Vectors that are null, zero, of another length than most of the sample, or hold null or
non-finite components take no part, nor do rows without an id. An id that stands at several
vectors is a candidate with each; as a query it asks with each, and its rows are ranked together.
Ties go to the smaller id. No rows come from an empty table; other columns may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import bounded_ids, materialize, one_row_an_id

TREES = 128
BITS = 20
K = 10
#: The bounded sample that the planes are taken from; index rows and queries in a block.
SAMPLE = 2_048
INDEX_BLOCK = 16_384
QUERY_BLOCK = 16_384
#: Vectors that are hashed at once.
CHUNK = 512
#: Entries over all trees at which a query stops ascending in a block: this many, and this share of the block's rows.
LEAST = 1_000
SHARE = 0.25


@dataclass
class Planes:
    normal: np.ndarray  # trees x bits x dims
    offset: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = 7) -> Planes:
        rng = np.random.default_rng(seed)
        a, b = sample[rng.integers(0, len(sample), (2, trees * bits))]
        same = ~(a != b).any(axis=1)
        normal = a - b
        normal[same] = rng.standard_normal((int(same.sum()), sample.shape[1]))
        offset = (normal * (a + b)).sum(axis=1) / 2
        return cls(normal.reshape(trees, bits, -1), offset.reshape(trees, bits))

    def strings(self, x: np.ndarray) -> np.ndarray:
        """trees x rows hash strings, the first bit highest."""
        trees, bits, dims = self.normal.shape
        normal, offset = self.normal.reshape(-1, dims).T, self.offset.reshape(-1)
        out = np.zeros((trees, len(x)), np.uint64)
        for at in range(0, len(x), CHUNK):
            side = (x[at : at + CHUNK] @ normal > offset).reshape(-1, trees, bits)
            for b in range(bits):
                out[:, at : at + CHUNK] |= side[:, :, b].T.astype(np.uint64) << np.uint64(bits - 1 - b)
        return out


class Forest:
    """Sorted hash strings of one block of distinct vectors."""

    def __init__(self, planes: Planes, x: np.ndarray):
        strings = planes.strings(x)
        self.order = np.argsort(strings, axis=1, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, axis=1)
        self.planes, self.bits = planes, planes.normal.shape[1]

    def candidates(self, queries: np.ndarray, least: int):
        """Rows of the block for each query, by synchronous ascent to `least` entries over all trees."""
        for at in range(0, len(queries), CHUNK):
            yield from self._ascend(self.planes.strings(queries[at : at + CHUNK]), least)

    def _ascend(self, strings: np.ndarray, least: int):
        lo = np.zeros((self.bits + 1, *strings.shape), np.int64)
        hi = np.zeros_like(lo)
        for keep in range(self.bits + 1):  # prefix ranges at each depth
            drop = np.uint64(self.bits - keep)
            start = strings >> drop << drop
            stop = start + ((np.uint64(1) << drop) - np.uint64(1))
            for t, entries in enumerate(self.sorted):
                lo[keep, t] = np.searchsorted(entries, start[t], side="left")
                hi[keep, t] = np.searchsorted(entries, stop[t], side="right")
        enough = (hi - lo).sum(axis=1) >= min(least, self.sorted.size)
        depth = self.bits - np.argmax(enough[::-1], axis=0)
        for q in range(strings.shape[1]):
            d = depth[q]
            yield np.unique(np.concatenate([self.order[t, lo[d, t, q] : hi[d, t, q]] for t in range(len(self.sorted))]))


def _valid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists(v, lambda x: x != 0))


def _matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors of the wanted length, their places)."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    good = np.flatnonzero(sizes == dims)
    starts = (np.cumsum(sizes) - sizes)[good]
    return flat[starts[:, None] + np.arange(dims)].reshape(len(good), dims), good


def search(index: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", share: float = SHARE, least: int = LEAST) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance) of the k nearest found."""
    spark = index.sparkSession
    rows, asked = _valid(index, id_col, vector_col), _valid(queries, id_col, vector_col)
    sampled = rows.join(F.broadcast(bounded_ids(rows.select("vec_id"), "vec_id", SAMPLE).distinct()), "vec_id", "left_semi")
    drawn = one_row_an_id(sampled, "vec_id").orderBy("vec_id").toArrow()
    schema = "query_id long, vec_id long, score double"
    dims = int(np.bincount(drawn["vector"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)).argmax()) if drawn.num_rows else 0
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    planes = Planes.fit(_matrix(drawn["vector"].combine_chunks(), dims)[0])
    nearest = Window.partitionBy("query_id").orderBy("score", "vec_id")
    blocks = max(1, -(-asked.count() // (QUERY_BLOCK // 2)))
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow()
        if not part.num_rows:
            continue
        x, good = _matrix(part["vector"].combine_chunks(), dims)
        shared = spark.sparkContext.broadcast((planes, part["vec_id"].to_numpy()[good], x))
        found = rows.mapInArrow(_pass(shared, k, share, least), schema)
        found = found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        out = out.unionByName(materialize(found, "nearest"))
        shared.destroy()
    return out


def _pass(shared, k: int, share: float, least: int):
    def block(planes, ids, x, query_ids, queries):
        order = np.lexsort((ids, *x.T[::-1]))
        ids, x = ids[order], x[order]
        first = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]).any(axis=1)])
        size = np.diff(np.r_[first, len(ids)])
        distinct = x[first]
        forest = Forest(planes, distinct)
        out = ([], [], [])
        for q, near in enumerate(forest.candidates(queries, max(least, int(share * len(distinct))))):
            away = np.sqrt(((distinct[near] - queries[q]) ** 2).sum(axis=1))
            few = np.argsort(away, kind="stable")
            cut = min(len(few), k + 1)
            few = few[away[few] <= away[few[cut - 1]]] if cut else few
            got = [(away[i], ids[j]) for i in few for j in range(first[near[i]], first[near[i]] + min(size[near[i]], k + 1)) if ids[j] != query_ids[q]]
            for d, i in sorted(got)[:k]:
                for col, v in zip(out, (query_ids[q], i, d)):
                    col.append(v)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    def run(batches):
        planes, query_ids, queries = shared.value
        held_ids, held, n = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, INDEX_BLOCK):
                part = batch.slice(at, INDEX_BLOCK)
                x, good = _matrix(part.column(1), queries.shape[1])
                held_ids.append(part.column(0).to_numpy()[good])
                held.append(x)
                n += len(x)
                if n >= INDEX_BLOCK:
                    yield block(planes, np.concatenate(held_ids), np.concatenate(held), query_ids, queries)
                    held_ids, held, n = [], [], 0
        if n:
            yield block(planes, np.concatenate(held_ids), np.concatenate(held), query_ids, queries)

    return run
