"""Level equations whose combinations are beyond what a driver holds.

Rows are dealt once by the levels of the term with most of them (the lead) and packed. Within a
partition the lead's effects are eliminated exactly, so conjugate gradients run on the levels of the
other terms alone: an iteration is one pass over the packed rows, and only sums by those levels
come to the driver. The lead's effects stay a table.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from absorbia.plans.specs import FixedEffect
from absorbia.sources.scratch import discard, forget, materialize

from . import absorb

#: Rows of one packed partition.
ROWS = 400_000


@dataclass
class Layout:
    """The lead's place, levels and code tables of the other terms, number of partitions."""

    lead: int
    keys: list
    codes: list
    parts: int


def layout(df: DataFrame, terms: list[FixedEffect], force: bool = False) -> Layout | None:
    """How to spread the terms' combinations, or None where a driver holds them (as far as counted in passing)."""
    if len(terms) < 2:
        return None
    every = list(dict.fromkeys(k for t in terms for k in t.keys))
    about = lambda keys: F.approx_count_distinct(F.xxhash64(*keys), 0.02)
    row = df.agg(F.count(F.lit(1)), about(every), *[about(t.keys) for t in terms]).first()
    if not force and min(row[0], row[1]) <= absorb.MAX_CELLS:
        return None
    lead = int(np.argmax(row[2:]))
    keys, codes = [None] * len(terms), [None] * len(terms)
    for i, t in enumerate(terms):
        if i != lead:
            keys[i], codes[i] = coded(df, t.keys, f"_o{i}")
    return Layout(lead, keys, codes, max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(row[0] / ROWS)))


def coded(df: DataFrame, keys: tuple[str, ...], name: str) -> tuple[list[tuple], DataFrame]:
    """(levels, table of the keys and the level's place as `name`)."""
    table = df.select(*keys).distinct().toArrow().combine_chunks()
    codes = table.append_column(name, pa.array(np.arange(table.num_rows, dtype=np.int32)))
    frame = df.sparkSession.createDataFrame(codes)
    return list(zip(*(table[k].to_pylist() for k in keys))), F.broadcast(frame) if table.num_rows <= absorb.MAX_BROADCAST else frame


def dense(table: pa.Table, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code of each row, a row of each code) for the combinations of keys."""
    code, first = np.zeros(table.num_rows, np.int64), np.zeros(1, np.int64)
    for k in keys:
        part = table[k].combine_chunks().dictionary_encode(null_encoding="encode")
        code = code * max(len(part.dictionary), 1) + part.indices.to_numpy(zero_copy_only=False)
        _, first, code = np.unique(code, return_index=True, return_inverse=True)
    return code, first


def _small(code: np.ndarray, n: int) -> np.ndarray:
    return code.astype(np.uint16 if n <= 1 << 16 else np.int32)


def _times(values: np.ndarray, base) -> np.ndarray:
    return values if base is None else values * base[:, None]


class _Part:
    """Rows of a partition in the order of the lead's levels."""

    def __init__(self, table: pa.Table, lead: list[str], lead_bases: list[str], others: list[tuple[str, int, list[str]]], slopes: list[str], width: int):
        code, first = dense(table, lead)
        order = np.argsort(code, kind="stable")
        take = lambda name: table[name].to_numpy()[order]
        self.count = np.bincount(code)
        self.keys = table.select(lead).take(pa.array(first))
        w = take("_w_")
        self.weight = None if (w == 1).all() else w
        self.bases = {absorb.ONE: None, **{s: take(f"_s{i}") for i, s in enumerate(slopes)}}
        self.lead_bases = lead_bases
        self.others = [(_small(take(name), n), n, bases) for name, n, bases in others]
        v = np.stack([take(f"_v{k}") for k in range(width)], axis=1).astype(float)
        grams = np.stack([np.stack([self.lead_sums(self.weighted(self.product(a, b)))[:, 0] for b in lead_bases], axis=1) for a in lead_bases], axis=1)
        self.blocks = np.linalg.pinv(grams, rcond=1e-12, hermitian=True)
        self.sums = self.by_lead(v)
        self.first = v

    def product(self, a, b):
        one = np.ones((int(self.count.sum()), 1))
        return _times(_times(one, self.bases[a]), self.bases[b])

    def weighted(self, values):
        return _times(values, self.weight)

    def lead_sums(self, values):
        return np.add.reduceat(values, np.cumsum(self.count) - self.count, axis=0)

    def by_lead(self, values):
        return np.stack([self.lead_sums(self.weighted(_times(values, self.bases[b]))) for b in self.lead_bases], axis=1)

    def lead_fit(self, effects):
        return sum(_times(np.repeat(effects[:, j], self.count, axis=0), self.bases[b]) for j, b in enumerate(self.lead_bases))

    def solve_lead(self, sums):
        return np.einsum("lab,lbk->lak", self.blocks, sums)

    def back(self, values):
        """Sums by level and basis of the other terms."""
        return [np.stack([absorb._sums(code, self.weighted(_times(values, self.bases[b])), n) for b in bases], axis=1) for code, n, bases in self.others]

    def fit(self, x):
        return sum(_times(e[code, j], self.bases[b]) for (code, _, bases), e in zip(self.others, x) for j, b in enumerate(bases))

    def reduced(self, values):
        """Values less what the lead's effects explain of them."""
        return values - self.lead_fit(self.solve_lead(self.by_lead(values)))


def _packs(batches, name: str = "packed"):
    for batch in batches:
        for value in batch.column(name):
            yield pickle.loads(value.as_py())


def _summed(table: pa.Table) -> list:
    total = None
    for value in table["sums"]:
        part = pickle.loads(value.as_py())
        total = part if total is None else [a + b for a, b in zip(total, part)]
    return total


def solve(df: DataFrame, terms: list[FixedEffect], variables: dict, weight, plan: Layout, tolerance: float, most: int) -> absorb.Solution:
    """As absorb.solve, for any number of rows: the lead's effects are a table of its keys and x{basis}_{variable}."""
    width, lead = len(variables), terms[plan.lead]
    slopes = list(dict.fromkeys(s for t in terms for s in t.slopes))
    every = list(dict.fromkeys(k for t in terms for k in t.keys))
    at = [i for i in range(len(terms)) if i != plan.lead]
    rows = df.select(*every, weight.cast("double").alias("_w_"), *[F.col(s).cast("double").alias(f"_s{i}") for i, s in enumerate(slopes)], *[v.cast("double").alias(f"_v{k}") for k, v in enumerate(variables.values())])
    for i in at:
        rows = rows.join(plan.codes[i], list(terms[i].keys))
    per = [absorb.term_bases(t) for t in terms]
    others = [(f"_o{i}", len(plan.keys[i]), per[i]) for i in at]
    lead_keys, lead_bases = list(lead.keys), per[plan.lead]

    def pack(batches):
        batches = list(batches)
        if not sum(b.num_rows for b in batches):
            return
        p = _Part(pa.Table.from_batches(batches), lead_keys, lead_bases, others, slopes, width)
        values, p.first = p.first, None
        whole = p.back(values)
        diagonal = [np.stack([np.stack([np.bincount(code, p.weighted(p.product(a, b))[:, 0], n) for b in bases], axis=1) for a in bases], axis=1) for code, n, bases in p.others]
        size = np.einsum("lak,lak->k", p.sums, p.solve_lead(p.sums))
        sums = [*whole, *p.back(p.reduced(values)), *diagonal, size]
        yield pa.RecordBatch.from_pydict({"packed": pa.array([pickle.dumps(p)], pa.binary()), "sums": pa.array([pickle.dumps(sums)], pa.binary())})

    placed = rows.select(*lead_keys, *[o[0] for o in others], *[c for c in rows.columns if c[:2] in ("_w", "_s", "_v")])
    packed = materialize(placed.repartition(plan.parts, *lead_keys).mapInArrow(pack, "packed binary, sums binary"), "packed")
    forget(df.sparkSession)
    try:
        start = _summed(_totals(packed))
        m = len(at)
        whole, rhs, diagonal, size = start[:m], start[m : 2 * m], start[2 * m : 3 * m], start[3 * m]
        blocks = [np.linalg.pinv(g, rcond=1e-12, hermitian=True) for g in diagonal]
        scale = lambda r: [np.einsum("lab,lbk->lak", p, x) for p, x in zip(blocks, r)]
        size = size + sum((x * y).sum(axis=(0, 1)) for x, y in zip(whole, scale(whole)))

        def apply(x):
            def one(batches):
                total = None
                for p in _packs(batches):
                    part = p.back(p.reduced(p.fit(x)))
                    total = part if total is None else [a + b for a, b in zip(total, part)]
                if total is not None:
                    yield pa.RecordBatch.from_pydict({"sums": pa.array([pickle.dumps(total)], pa.binary())})

            return _summed(packed.select("packed").mapInArrow(one, "sums binary").toArrow())

        x, it, error = absorb.conjugate(rhs, scale, apply, size, tolerance, most)
        kinds = [df.schema[k] for k in lead_keys]
        columns = [f"{c}{b}_{k}" for c in "xs" for b in range(len(lead_bases)) for k in range(width)]

        def finish(batches):
            for p in _packs(batches):
                u = p.solve_lead(p.sums - p.by_lead(p.fit(x)))
                arrays = [c.combine_chunks() for c in p.keys.columns]
                arrays += [pa.array(np.ascontiguousarray(a[:, b, k])) for a in (u, p.sums) for b in range(u.shape[1]) for k in range(width)]
                yield from pa.table(arrays, names=[*lead_keys, *columns]).to_batches(max_chunksize=50_000)

        from pyspark.sql.types import DoubleType, StructField, StructType

        table = materialize(packed.select("packed").mapInArrow(finish, StructType([*kinds, *[StructField(c, DoubleType()) for c in columns]])), "effects")
    finally:
        discard(packed)
    bases = range(len(lead_bases))
    cross = [[sum((F.col(f"s{b}_{k}") * F.col(f"x{b}_{j}") for b in bases), F.lit(0.0)) for j in range(width)] for k in range(width)]
    row = table.agg(*[F.sum(c) for line in cross for c in line]).first()
    explained = np.array([v or 0.0 for v in row], float).reshape(width, width)
    for full, e in zip(whole, x):
        explained = explained + np.einsum("lbk,lbj->kj", full, e)
    effects, keys = [None] * len(terms), list(plan.keys)
    for i, e in zip(at, x):
        effects[i] = e
    effects[plan.lead] = table.drop(*[c for c in columns if c[0] == "s"])
    return absorb.Solution(list(terms), keys, effects, it, error, explained, table)


def _totals(packed: DataFrame) -> pa.Table:
    """The partitions' sums, added up within tasks."""

    def add(batches):
        total = None
        for part in _packs(batches, "sums"):
            total = part if total is None else [a + b for a, b in zip(total, part)]
        if total is not None:
            yield pa.RecordBatch.from_pydict({"sums": pa.array([pickle.dumps(total)], pa.binary())})

    return packed.select("sums").mapInArrow(add, "sums binary").toArrow()
