"""Moment matrices and sandwich meats as grouped aggregations."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from absorbia.errors import AbsorbiaError
from absorbia.functions import kernels
from absorbia.sources.scratch import checkpoint


def gram(df: DataFrame, left: list[Column], right: list[Column] | None = None, weight: Column | None = None) -> np.ndarray:
    """Sum of w * left' right in one aggregate; symmetric when right is not given."""
    w = weight if weight is not None else F.lit(1.0)
    k, m = len(left), len(right if right is not None else left)
    pairs = [(i, j) for i in range(k) for j in range(m) if right is not None or i <= j]
    row = df.agg(*[F.sum(w * left[i] * (right[j] if right is not None else left[j])).alias(f"g{n}") for n, (i, j) in enumerate(pairs)]).first()
    out = np.zeros((k, m))
    for n, (i, j) in enumerate(pairs):
        out[i, j] = row[n] or 0.0
        if right is None:
            out[j, i] = out[i, j]
    return out


def column_moments(df: DataFrame, columns: list[str], weight: str | None = None) -> dict[str, tuple[float, float]]:
    """Mean and sample standard deviation (floor 1e-3) of each column."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    sums = [F.sum(w)]
    for c in columns:
        x = F.col(c).cast("double")
        sums += [F.sum(w * x), F.sum(w * x * x)]
    row = df.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
    n, out = row[0], {}
    for i, c in enumerate(columns):
        mean = row[1 + 2 * i] / n
        var = (row[2 + 2 * i] - n * mean * mean) / max(n - 1, 1)
        sd = float(np.sqrt(var)) if var > 0 else 0.0
        out[c] = (mean, max(sd, 1e-3) if np.isfinite(sd) else 1.0)
    return out


def cluster_meat(df: DataFrame, scores: list[Column], keys: list[str]) -> tuple[np.ndarray, int]:
    """(sum over clusters of s s', number of clusters); partial sums combine before the shuffle."""
    names = [f"_s{i}" for i in range(len(scores))]
    summed = df.groupBy(*keys).agg(*[F.sum(s).alias(n) for s, n in zip(scores, names)])
    cols = [F.col(n) for n in names]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = summed.agg(F.count(F.lit(1)), *[F.sum(cols[i] * cols[j]).alias(f"g{n}") for n, (i, j) in enumerate(pairs)]).first()
    out = np.zeros((len(cols), len(cols)))
    for n, (i, j) in enumerate(pairs):
        out[i, j] = out[j, i] = row[n + 1] or 0.0
    return out, row[0]


def multiway_meat(df: DataFrame, scores: list[Column], clusters: list[str]) -> tuple[np.ndarray, list[int]]:
    """Inclusion-exclusion over all non-empty sets of cluster keys; counts of the single keys."""
    total, counts = 0.0, []
    for r in range(1, len(clusters) + 1):
        for keys in combinations(clusters, r):
            meat, n = cluster_meat(df, scores, list(keys))
            total = total + (-1) ** (r + 1) * meat
            if r == 1:
                counts.append(n)
    if min(counts) < 2:
        raise AbsorbiaError("inference.clusters", "a cluster column has fewer than two levels", stage="inference")
    return total, counts


def _time_number(df: DataFrame, time: str) -> Column:
    kind = df.schema[time].dataType.simpleString()
    c = F.col(time)
    return F.unix_micros(c.cast("timestamp")).cast("double") if kind.startswith(("timestamp", "date")) else c.cast("double")


def hac_meat(df: DataFrame, scores: list[Column], time: str, kernel: str = "bartlett", bandwidth: float | None = None, panel: str | None = None, across: bool = False) -> tuple[np.ndarray, int, float]:
    """(meat, periods, bandwidth): kernel-weighted autocovariances of scores.

    Times are numbered in steps of the least difference, and lags join on these numbers, so gaps
    give no pair and rounding of times loses none. `across` sums scores by period first
    (Driscoll-Kraay). A time that repeats within a panel is an error.
    """
    names = [f"_s{i}" for i in range(len(scores))]
    keys = ([panel] if panel and not across else [])
    base = df.select(*[F.col(k).alias("_p") for k in keys], _time_number(df, time).alias("_t"), *[s.alias(n) for s, n in zip(scores, names)])
    group = ["_p"] * bool(keys) + ["_t"]
    if across:
        base = base.groupBy("_t").agg(*[F.sum(n).alias(n) for n in names])
    elif not base.groupBy(*group).count().where("count > 1").isEmpty():
        raise AbsorbiaError("inference.time", "times repeat" + (" within a panel" if keys else "; a panel column is needed"), stage="inference")
    base = base.persist()
    try:
        step, first, span, periods = _step_and_span(base, keys)
        width = bandwidth if bandwidth is not None else kernels.automatic_bandwidth(periods)
        cols = [F.col(n) for n in names]
        meat = gram(base, cols)
        x = (F.col("_t") - F.lit(first)) / F.lit(step)
        whole = F.floor(x + F.lit(5e-7))  # steps, and millionths of a step beside them
        placed = base.select(*["_p"] * bool(keys), whole.alias("_i"), F.round((x - whole) * 1e6).cast("long").alias("_f"), *names)
        on = [*["_p"] * bool(keys), "_i", "_f"]
        for lag in range(1, kernels.max_lag(kernel, width, span) + 1):
            k = kernels.weight(kernel, lag, width)
            if k:
                behind = placed.select(*["_p"] * bool(keys), (F.col("_i") + F.lit(lag)).alias("_i"), "_f", *[F.col(n).alias(f"{n}b") for n in names])
                gamma = gram(placed.join(behind, on), cols, [F.col(f"{n}b") for n in names])
                meat = meat + k * (gamma + gamma.T)
        return meat, periods, float(width)
    finally:
        base.unpersist()


def _step_and_span(base: DataFrame, keys: list[str]) -> tuple[float, float, int, int]:
    """Least positive time step (within a panel), first time, span in steps, number of distinct times."""
    if keys:
        distinct = base.select("_p", "_t").distinct()
        gaps = distinct.select((F.col("_t") - F.lag("_t").over(Window.partitionBy("_p").orderBy("_t"))).alias("g"))
        step = gaps.where("g > 0").agg(F.min("g")).first()[0]
        first, last, n = distinct.agg(F.min("_t"), F.max("_t"), F.count_distinct("_t")).first()
    else:  # one series: ranges of times are ordered apart, and their ends compared here
        ranged = checkpoint(base.select("_t").distinct().repartitionByRange("_t").withColumn("_r", F.spark_partition_id()))
        within = ranged.withColumn("g", F.col("_t") - F.lag("_t").over(Window.partitionBy("_r").orderBy("_t")))
        ends = sorted(tuple(r) for r in within.groupBy("_r").agg(F.min("_t"), F.max("_t"), F.min("g"), F.count("_t")).select("min(_t)", "max(_t)", "min(g)", "count(_t)").collect())
        step = min([e[2] for e in ends if e[2]] + [b[0] - a[1] for a, b in zip(ends, ends[1:])], default=None)
        first, last, n = (ends[0][0], ends[-1][1], sum(e[3] for e in ends)) if ends else (0.0, 0.0, 0)
    step = step or 1.0
    return step, first or 0.0, int(round(((last or 0.0) - (first or 0.0)) / step)), n


def repair(v: np.ndarray, scale: np.ndarray | None = None) -> np.ndarray:
    """Where an eigenvalue is negative, the nearest positive semidefinite matrix in scaled coordinates."""
    if np.linalg.eigvalsh(v).min() >= 0:
        return v
    s = np.ones(len(v)) if scale is None else scale
    values, vectors = np.linalg.eigh(v * np.outer(s, s))
    return (vectors * np.maximum(values, 0)) @ vectors.T / np.outer(s, s)


def repair_scaled(v: np.ndarray, rows: DataFrame, columns: list[str]) -> np.ndarray:
    """repair in units of the columns' standard deviations; the constant's is one."""
    sd = column_moments(rows, [c for c in columns if c != "_cons"])
    return repair(v, np.array([sd[c][1] if c in sd else 1.0 for c in columns]))


def inverse(a: np.ndarray) -> np.ndarray:
    """Symmetric inverse in unit-diagonal scaling, eigenvalues below 1e-15 of the largest cut."""
    s = 1 / np.sqrt(np.maximum(np.diag(a), 1e-300))
    values, vectors = np.linalg.eigh(a * np.outer(s, s))
    keep = values > 1e-15 * values.max(initial=0)
    return (vectors[:, keep] / values[keep]) @ vectors[:, keep].T * np.outer(s, s)
