"""Fixed-effect projection in the space of levels.

Rows are aggregated once to observed combinations of levels; the normal equations of the levels
are solved there by preconditioned conjugate gradients, and level effects are joined back to the
rows. One intercept term needs no solve: group means are the effects. Where the number of
combinations is beyond what a driver holds, the rows stay in Spark (see spread).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from absorbia.errors import AbsorbiaError
from absorbia.plans.specs import FixedEffect
from absorbia.sources.scratch import checkpoint


#: Combinations that the driver may hold, level effects that may be broadcast, stopping rule.
MAX_CELLS = 3_000_000
MAX_BROADCAST = 200_000
TOLERANCE = 1e-12
MAX_ITERATIONS = 16_000


@dataclass
class Solution:
    """Effects of every column in every term: level tables with one column a basis and variable.

    A term without keys has its effects in Spark, as a table of its keys and x{basis}_{variable}.
    """

    terms: list[FixedEffect]
    keys: list[list[tuple] | None]
    effects: list[np.ndarray | DataFrame]  # levels x bases x variables
    iterations: int
    error: float
    explained: np.ndarray | None = None  # variables x variables: their sums of products that the effects take
    table: DataFrame | None = None  # what the effects in Spark are read from

    def mapped(self, weights: np.ndarray) -> Solution:
        """Effects of linear combinations of the variables: weights is variables x combinations."""
        effects = []
        for t, e in zip(self.terms, self.effects):
            if isinstance(e, np.ndarray):
                effects.append(e @ weights)
                continue
            new = {}
            for b in range(len(term_bases(t))):
                for j in range(weights.shape[1]):
                    total = F.lit(0.0)
                    for k, c in enumerate(weights[:, j]):
                        total = total + F.lit(float(c)) * F.col(f"x{b}_{k}") if c else total
                    new[f"x{b}_{j}"] = total
            effects.append(e.select(*t.keys, *[c.alias(n) for n, c in new.items()]))
        return Solution(self.terms, self.keys, effects, self.iterations, self.error, None, self.table)


@dataclass
class Cells:
    """Moments of bases and variables by combination of levels, on the driver."""

    terms: list[FixedEffect]
    keys: list[list[tuple]]
    code: list[np.ndarray]
    bases: list[str]
    moments: dict[tuple[str, str], np.ndarray]
    cross: dict[str, np.ndarray]  # basis -> cells x variables


ONE = "1"


def level_codes(table: pa.Table, keys: tuple[str, ...]) -> tuple[np.ndarray, list[tuple]]:
    """(code of each row, levels by code) for the combinations of keys in a table; nulls are a level."""
    code, parts = np.zeros(table.num_rows, np.int64), []
    for k in keys:
        part = table[k].combine_chunks().dictionary_encode(null_encoding="encode")
        parts.append(part.dictionary)
        code = code * max(len(part.dictionary), 1) + part.indices.to_numpy(zero_copy_only=False)
        if len(keys) > 1:  # dense again, so that products of many keys stay small
            _, first, code = np.unique(code, return_index=True, return_inverse=True)
    if len(keys) == 1:
        return code, [(v,) for v in parts[0].to_pylist()]
    return code, list(zip(*(table[k].take(pa.array(first)).to_pylist() for k in keys)))


def collect_cells(df: DataFrame, terms: list[FixedEffect], variables: dict, weight, strict: bool = True) -> Cells | None:
    """One grouped aggregation over all terms' keys. Beyond MAX_CELLS combinations an error, or None if not strict."""
    keys = list(dict.fromkeys(k for t in terms for k in t.keys))
    bases = list(dict.fromkeys([ONE] * any(t.intercept for t in terms) + [s for t in terms for s in t.slopes]))
    column = lambda b: F.lit(1.0) if b == ONE else F.col(b).cast("double")
    sums = [F.sum(weight * column(a) * column(b)).alias(f"_m{i}_{j}") for i, a in enumerate(bases) for j, b in enumerate(bases) if i <= j]
    sums += [F.sum(weight * column(b) * v).alias(f"_c{i}_{k}") for i, b in enumerate(bases) for k, v in enumerate(variables.values())]
    grouped = df.groupBy(*keys).agg(*sums)
    table = grouped.limit(MAX_CELLS + 1).toArrow()
    if table.num_rows > MAX_CELLS:
        if not strict:
            return None
        raise AbsorbiaError("absorb.cells", "too many combinations of levels for the driver", stage="absorb")
    codes, levels = (list(x) for x in zip(*(level_codes(table, t.keys) for t in terms)))
    number = lambda name: table[name].to_numpy().astype(float)
    moments = {}
    for i, a in enumerate(bases):
        for j, b in enumerate(bases):
            if i <= j:
                moments[a, b] = moments[b, a] = number(f"_m{i}_{j}")
    cross = {b: np.stack([number(f"_c{i}_{k}") for k in range(len(variables))], axis=1) for i, b in enumerate(bases)}
    return Cells(terms, levels, codes, bases, moments, cross)


def term_bases(t: FixedEffect) -> list[str]:
    return [ONE] * t.intercept + list(t.slopes)


def solve(c: Cells, tolerance: float = TOLERANCE, most: int = MAX_ITERATIONS) -> Solution:
    """Level effects of all variables at once, by conjugate gradients with block-diagonal scaling.

    Raises solver.not_converged where a variable is not within the tolerance after `most` iterations.
    """
    sizes = [len(k) for k in c.keys]
    per = [term_bases(t) for t in c.terms]
    rhs, blocks = [], []
    for code, n, bases in zip(c.code, sizes, per):
        rhs.append(np.stack([_sums(code, c.cross[b], n) for b in bases], axis=1))
        g = np.stack([np.stack([np.bincount(code, c.moments[a, b], n) for b in bases], axis=1) for a in bases], axis=1)
        blocks.append(np.linalg.pinv(g, rcond=1e-12, hermitian=True))

    def apply(x):
        out = []
        for code, n, bases in zip(c.code, sizes, per):
            parts = []
            for a in bases:
                total = 0.0
                for other, others, y in zip(c.code, per, x):
                    for j, b in enumerate(others):
                        total = total + c.moments[a, b][:, None] * y[other, j]
                parts.append(_sums(code, total, n))
            out.append(np.stack(parts, axis=1))
        return out

    scale = lambda r: [np.einsum("lab,lbk->lak", p, x) for p, x in zip(blocks, r)]
    dot = lambda a, b: sum((x * y).sum(axis=(0, 1)) for x, y in zip(a, b))
    explained = lambda x: sum(np.einsum("lbk,lbj->kj", a, b) for a, b in zip(rhs, x))
    if len(sizes) == 1:
        return Solution(c.terms, c.keys, scale(rhs), 1, 0.0, explained(scale(rhs)))
    x, it, error = conjugate(rhs, scale, apply, dot(rhs, scale(rhs)), tolerance, most)
    return Solution(c.terms, c.keys, x, it, error, explained(x))


def conjugate(rhs: list[np.ndarray], scale, apply, size: np.ndarray, tolerance: float, most: int) -> tuple[list[np.ndarray], int, float]:
    """(solution, iterations, error) of apply(x) = rhs by conjugate gradients, scaled; size: what the error is measured by."""
    dot = lambda a, b: sum((x * y).sum(axis=(0, 1)) for x, y in zip(a, b))
    x = [np.zeros_like(r) for r in rhs]
    r, z = rhs, scale(rhs)
    p, rz = z, dot(rhs, z)
    start, it = np.maximum(size, 1e-300), 0
    while it < most and (np.sqrt(np.maximum(rz, 0) / start) > tolerance).any():
        it += 1
        q = apply(p)
        pq = dot(p, q)
        alpha = np.where(pq > 0, rz / np.where(pq > 0, pq, 1), 0.0)
        x = [a + alpha * b for a, b in zip(x, p)]
        r = [a - alpha * b for a, b in zip(r, q)]
        z = scale(r)
        new = dot(r, z)
        beta = np.where(rz > 0, new / np.where(rz > 0, rz, 1), 0.0)
        p, rz = [a + beta * b for a, b in zip(z, p)], new
    error = float(np.sqrt(np.maximum(rz, 0) / start).max())
    if not error <= tolerance:
        raise AbsorbiaError("solver.not_converged", f"no convergence in {it} iterations", stage="absorb", iterations=it, error=error)
    return x, it, error


def _sums(code: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(code, values[:, k], n) for k in range(values.shape[1])], axis=1)


def solution(df: DataFrame, terms: list[FixedEffect], variables: dict, weight, plan=None, tolerance: float = TOLERANCE, most: int = MAX_ITERATIONS) -> Solution:
    """Level effects of the variables, on the driver where it holds the combinations, else by rows.

    plan: of spread.layout, False where it gave none, None where it was not asked.
    """
    from . import spread

    plan = spread.layout(df, terms) if plan is None else plan
    cells = None if plan else collect_cells(df, terms, variables, weight, strict=len(terms) < 2)
    if cells is not None:
        return solve(cells, tolerance, most)
    return spread.solve(df, terms, variables, weight, plan or spread.layout(df, terms, force=True), tolerance, most)


def basis_table(df: DataFrame, t: FixedEffect, keys: list[tuple] | None, effects: np.ndarray | DataFrame, b: int) -> DataFrame:
    """Effects of one basis on the first variable: the term's keys, then effect."""
    if keys is None:
        return effects.select(*t.keys, F.col(f"x{b}_0").alias("effect"))
    return effects_table(df, t, keys, effects[:, b : b + 1, :1], "effect_").withColumnRenamed("effect_0_0", "effect")


def effects_table(df: DataFrame, t: FixedEffect, keys: list[tuple] | None, effects: np.ndarray | DataFrame, prefix: str) -> DataFrame:
    """A term's effects as a table: its keys, then {prefix}{basis}_{variable}."""
    if keys is None:
        return effects.select(*t.keys, *[F.col(c).alias(f"{prefix}{c[1:]}") for c in effects.columns if c not in t.keys])
    spark = df.sparkSession
    from pyspark.sql.pandas.types import to_arrow_type

    columns = [pa.array([k[i] for k in keys], to_arrow_type(df.schema[name].dataType)) for i, name in enumerate(t.keys)]
    names = list(t.keys)
    for b in range(effects.shape[1]):
        for v in range(effects.shape[2]):
            columns.append(pa.array(effects[:, b, v].copy()))
            names.append(f"{prefix}{b}_{v}")
    return spark.createDataFrame(pa.table(columns, names=names))


def join_effects(df: DataFrame, s: Solution, names: list[str], prefix: str = "_fe") -> DataFrame:
    """df with the sum of all terms' effects on each variable, as the columns `names`."""
    totals = [F.lit(0.0) for _ in names]
    out = df
    for i, (t, keys, effects) in enumerate(zip(s.terms, s.keys, s.effects)):
        table = effects_table(df, t, keys, effects, f"{prefix}{i}_")
        wide = table.hint("shuffle_hash") if keys is None else table
        out = out.join(F.broadcast(table) if keys is not None and len(keys) <= MAX_BROADCAST else wide, list(t.keys))
        for v in range(len(names)):
            for b, basis in enumerate(term_bases(t)):
                value = F.col(f"{prefix}{i}_{b}_{v}")
                totals[v] = totals[v] + (value if basis == ONE else value * F.col(basis).cast("double"))
    gone = [c for c in out.columns if c.startswith(prefix)]
    return out.withColumns(dict(zip(names, totals))).drop(*gone)


def residualize(df: DataFrame, terms: list[FixedEffect], variables: list[str], weight: str | None = None, suffix: str = "_r", tolerance: float = TOLERANCE) -> tuple[DataFrame, Solution | None]:
    """df with {variable}{suffix}: residuals on all terms, weighted."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    out = [f"{v}{suffix}" for v in variables]
    if not terms:
        return df.withColumns({o: F.col(v).cast("double") for o, v in zip(out, variables)}), None
    if len(terms) == 1 and not terms[0].slopes:
        means = df.groupBy(*terms[0].keys).agg(*[(F.sum(w * F.col(v).cast("double")) / F.sum(w)).alias(f"_mean{i}") for i, v in enumerate(variables)])
        joined = df.join(means, list(terms[0].keys))
        return joined.withColumns({o: F.col(v).cast("double") - F.col(f"_mean{i}") for i, (o, v) in enumerate(zip(out, variables))}).drop(*[f"_mean{i}" for i in range(len(variables))]), None
    s = solution(df, terms, {v: F.col(v).cast("double") for v in variables}, w, tolerance=tolerance)
    fitted = [f"_fit{i}" for i in range(len(variables))]
    joined = join_effects(df, s, fitted)
    return joined.withColumns({o: F.col(v).cast("double") - F.col(f) for o, v, f in zip(out, variables, fitted)}).drop(*fitted), s


def alternate(df: DataFrame, terms: list[FixedEffect], variables: list[str], weight: str | None = None, suffix: str = "_r", tolerance: float = TOLERANCE, sweeps: int = MAX_ITERATIONS) -> DataFrame:
    """Alternating projections, each a join of grouped means, in checkpoints of one sweep.

    For intercept terms of any size: nothing of the size of the levels comes to the driver. The
    largest mean a sweep takes out of a variable is held against the variable's own deviation (and
    rounding); solver.not_converged is raised where it stays above the tolerance.
    """
    if any(t.slopes for t in terms):
        raise AbsorbiaError("absorb.cells", "slopes with this many combinations are not supported", stage="absorb")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    out = [f"{v}{suffix}" for v in variables]
    frame = df.withColumns({o: F.col(v).cast("double") for o, v in zip(out, variables)})
    values = [F.col(v).cast("double") for v in variables]
    centre = df.agg(*[F.sum(w * v) / F.sum(w) for v in values]).first()
    spread = df.agg(*[F.sqrt(F.sum(w * (v - F.lit(c)) ** 2) / F.sum(w)) for v, c in zip(values, centre)]).first() if all(c is not None for c in centre) else [0.0] * len(out)
    bound = [tolerance * (s or 0.0) + 4 * np.finfo(float).eps * math.hypot(s or 0.0, c or 0.0) for s, c in zip(spread, centre)]
    for _ in range(sweeps):
        moved = []
        for t in terms:
            means = frame.groupBy(*t.keys).agg(*[(F.sum(w * F.col(o)) / F.sum(w)).alias(f"_m{i}") for i, o in enumerate(out)])
            means = checkpoint(means)
            moved.append([m or 0.0 for m in means.agg(*[F.max(F.abs(F.col(f"_m{i}"))) for i in range(len(out))]).first()])
            frame = frame.join(means, list(t.keys)).withColumns({o: F.col(o) - F.col(f"_m{i}") for i, o in enumerate(out)}).drop(*[f"_m{i}" for i in range(len(out))])
        frame = checkpoint(frame)
        if all(m <= b for sweep in moved[1:] or moved for m, b in zip(sweep, bound)):
            return frame
    raise AbsorbiaError("solver.not_converged", f"no convergence in {sweeps} sweeps", stage="absorb", sweeps=sweeps)


def certificate(df: DataFrame, terms: list[FixedEffect], column: str, weight: str | None = None) -> float:
    """The largest absolute weighted mean of a residual within any level."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return max((df.groupBy(*t.keys).agg(F.abs(F.sum(w * F.col(column)) / F.sum(w)).alias("m")).agg(F.max("m")).first()[0] for t in terms if t.intercept), default=0.0)
