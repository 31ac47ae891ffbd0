"""Guards and reports computed in one aggregate over the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from absorbia.errors import AbsorbiaError

NUMERIC = (T.NumericType, T.BooleanType)


def number(name: str) -> Column:
    return F.col(f"`{name}`").cast("double")


def invalid(name: str) -> Column:
    """Null, NaN or infinite."""
    c = number(name)
    return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))


def valid_sample(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows where every column is valid: finite where numeric, not null otherwise."""
    keep = F.lit(True)
    for c in columns:
        keep = keep & (~invalid(c) if isinstance(df.schema[c].dataType, NUMERIC) else F.col(f"`{c}`").isNotNull())
    return df.where(keep)


def require(df: DataFrame, numeric: list[str], identifiers: list[str], nonnegative: list[str] = (), positive: list[str] = (), integer: list[str] = ()) -> int:
    """Raise on a missing or non-finite value; the number of rows otherwise."""
    for c in numeric:
        if not isinstance(df.schema[c].dataType, NUMERIC):
            raise AbsorbiaError("input.dtype", f"{c} is not numeric", stage="validation", column=c)
    tests = [("input.non_finite", c, invalid(c)) for c in numeric]
    tests += [("input.missing_identifier", c, F.col(f"`{c}`").isNull()) for c in identifiers]
    tests += [("input.negative", c, number(c) < 0) for c in nonnegative]
    tests += [("input.not_positive", c, number(c) <= 0) for c in positive]
    tests += [("input.not_integer", c, F.abs(number(c) - F.round(number(c))) > 1e-12) for c in integer]
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(t).alias(f"t{i}") for i, (_, _, t) in enumerate(tests)]).first()
    for i, (code, column, _) in enumerate(tests):
        if row[f"t{i}"]:
            raise AbsorbiaError(code, f"{column}: {row[f't{i}']} bad rows", stage="validation", column=column)
    if not row["n"]:
        raise AbsorbiaError("sample.empty", "no rows", stage="validation")
    return row["n"]


def preflight(df: DataFrame, roles: dict[str, list[str]], poisson: bool = False, strict: bool = False) -> DataFrame:
    """Issues as rows (level, code, column, count), none if all is well; one pass over the table.

    roles: role -> columns. Strict adds warnings: few clusters, near-constant columns, uneven
    weights, a large share of zero outcomes.
    """
    spark, found, tests = df.sparkSession, [], []
    ids = {"fixed_effect", "cluster", "factor", "group", "individual"}
    for role, columns in roles.items():
        for c in columns:
            if c not in df.columns:
                found.append(("error", "data.missing_column", c, 1))
                continue
            col = F.col(f"`{c}`")
            if role in ids:
                tests.append(("error", "input.missing_identifier", c, F.count_if(col.isNull())))
                if strict and role == "cluster":
                    tests.append(("warning", "inference.few_clusters", c, F.when(F.count_distinct(col) < 30, F.count_distinct(col)).otherwise(F.lit(0))))
                continue
            if not isinstance(df.schema[c].dataType, NUMERIC):
                found.append(("error", "input.dtype", c, 1))
                continue
            x = number(c)
            tests.append(("error", "input.missing", c, F.count_if(x.isNull() | F.isnan(x))))
            tests.append(("error", "input.infinite", c, F.count_if(F.abs(x) == float("inf"))))
            if role == "outcome" and poisson:
                tests.append(("error", "input.negative_outcome", c, F.count_if(x < 0)))
                if strict:
                    tests.append(("warning", "input.zero_share", c, F.when(F.avg((x == 0).cast("double")) > 0.99, F.count_if(x == 0)).otherwise(F.lit(0))))
            if role == "exposure":
                tests.append(("error", "input.exposure", c, F.count_if(x <= 0)))
            if strict and role == "regressor":
                tests.append(("warning", "input.near_constant", c, F.when(F.stddev_pop(x) <= 1e-12 * (F.lit(1.0) + F.abs(F.avg(x))), F.count(x)).otherwise(F.lit(0))))
            if strict and role == "weights":
                tests.append(("warning", "input.weight_ratio", c, F.when(F.max(x) > 1e6 * F.min(F.when(x > 0, x)), F.count(x)).otherwise(F.lit(0))))
    if tests:
        row = df.agg(*[t.cast("long").alias(f"t{i}") for i, (_, _, _, t) in enumerate(tests)]).first()
        found += [(level, code, c, int(row[f"t{i}"] or 0)) for i, (level, code, c, _) in enumerate(tests) if row[f"t{i}"]]
    return spark.createDataFrame(found, "level string, code string, column string, count long")


def weights_normalised(df: DataFrame, weights: str, kind: str, name: str = "_w") -> tuple[DataFrame, float]:
    """(df with the working weight, effective number of rows).

    Frequency weights are positive integers and count rows; analytic and probability weights are
    positive and rescaled to sum to the number of rows; generic weights are nonnegative.
    """
    if kind == "fweight":
        require(df, [weights], [], positive=[weights], integer=[weights])
    elif kind in ("aweight", "pweight"):
        require(df, [weights], [], positive=[weights])
    else:
        require(df, [weights], [], nonnegative=[weights])
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(number(weights)).alias("s")).first()
    if not row["s"] or row["s"] <= 0:
        raise AbsorbiaError("input.weights", "all weights are zero", stage="validation")
    scale = row["n"] / row["s"] if kind in ("aweight", "pweight") else 1.0
    return df.withColumn(name, number(weights) * F.lit(scale)), row["s"] if kind == "fweight" else float(row["n"])
