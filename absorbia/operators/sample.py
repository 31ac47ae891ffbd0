"""Estimation samples: recursive removal of singletons and of levels without positive outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from absorbia.sources.scratch import checkpoint


def prune(df: DataFrame, terms: list, outcome: str | None = None, weights: str | None = None, singletons: bool = True) -> tuple[DataFrame, list[tuple[str, int]]]:
    """(kept rows, history): rows in singleton levels, and where an outcome is given those in
    levels whose outcomes are all zero, are removed until nothing changes.

    A level with one row is a singleton; with frequency weights the row must also have weight 1.
    Only levels that go are joined, so rounds after the first touch little.
    """
    history: list[tuple[str, int]] = []
    frame, changed = df, True
    while changed and terms:
        changed = False
        for t in terms:
            if not t.intercept and not t.slopes:
                continue
            mass = F.sum(F.col(weights)) if weights else F.count(F.lit(1)).cast("double")
            lone = (F.count(F.lit(1)) == 1) & (mass <= 1) if singletons and t.intercept else F.lit(False)
            zero = F.max(F.col(outcome)) <= 0 if outcome else F.lit(False)
            gone = frame.groupBy(*t.keys).agg(F.when(zero, "zero").when(lone, "singleton").alias("reason"), F.count(F.lit(1)).alias("n")).where(F.col("reason").isNotNull())
            gone = checkpoint(gone)
            counts = {r["reason"]: r["n"] for r in gone.groupBy("reason").agg(F.sum("n").alias("n")).collect()}
            if counts:
                changed = True
                history += sorted(counts.items())
                frame = frame.join(gone.select(*t.keys), list(t.keys), "left_anti")
        if changed:
            frame = checkpoint(frame)
    return frame, history


def separated_by_levels(df: DataFrame, terms: list, outcome: str) -> DataFrame:
    """Rows in some level without a positive outcome."""
    kept, _ = prune(df, terms, outcome=outcome, singletons=False)
    return df.exceptAll(kept)
