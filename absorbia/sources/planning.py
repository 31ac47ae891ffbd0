"""What a scan costs, from Catalyst's statistics: no rows are read."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame

from absorbia.errors import AbsorbiaError

from .readers import project


@dataclass(frozen=True)
class ScanPlan:
    """Projected columns with the bytes Catalyst expects, and the partitioning these call for."""

    columns: tuple[str, ...]
    bytes: int
    bytes_per_row: int
    partitions: int
    rows_per_batch: int


def bytes_per_row(df: DataFrame) -> int:
    """Catalyst's default width of a row: fixed types by size, strings and binaries by its assumed length."""
    return max(int(df._jdf.schema().defaultSize()), 1)


def plan_scan(df: DataFrame, columns: list[str], partition_bytes: int = 128 << 20, batch_bytes: int = 32 << 20, least_rows: int = 1_000, most_rows: int = 1_000_000) -> ScanPlan:
    """Bytes of the columns, the number of partitions of at most partition_bytes, and rows an Arrow batch of batch_bytes holds."""
    if partition_bytes < 1 or batch_bytes < 1 or not 1 <= least_rows <= most_rows:
        raise AbsorbiaError("data.plan", "budgets are positive and least_rows is at most most_rows", stage="data")
    part = project(df, columns)
    size = int(str(part._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    width = bytes_per_row(part)
    return ScanPlan(tuple(part.columns), size, width, max(1, math.ceil(size / partition_bytes)), min(most_rows, max(least_rows, batch_bytes // width)))
