"""Incremental moments of event streams (an extension: moments are additive)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from absorbia.operators.moments import inverse


def windowed_moments(stream: DataFrame, time: str, y: str, x: list[str], width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Per window: n and the sums of products of [1, x..., y]; works on batch and streaming tables."""
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in x], F.col(y).cast("double")]
    sums = [F.sum(cols[i] * cols[j]).alias(f"m{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]
    base = stream.withWatermark(time, late) if stream.isStreaming else stream
    return base.groupBy(F.window(time, width)).agg(F.count(F.lit(1)).alias("n"), *sums).select(F.col("window.start").alias("start"), "n", *[f"m{i}_{j}" for i in range(len(cols)) for j in range(i, len(cols))])


def coefficients(moments: DataFrame, x: list[str]) -> dict[str, float]:
    """Least squares of y on a constant and x from windows added up."""
    k = len(x) + 2
    row = moments.agg(*[F.sum(f"m{i}_{j}").alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    g = np.array([[row[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    return dict(zip(["_cons", *x], (inverse(g[:-1, :-1]) @ g[:-1, -1]).tolist()))
