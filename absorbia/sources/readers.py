"""Readers chosen by suffix; projections reach the scan."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from absorbia.errors import AbsorbiaError

#: Reader options that the engine sets itself.
RESERVED = {"columns", "usecols", "chunksize", "nrows", "iterator", "convert_categoricals"}
STATA_ROWS = 200_000


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns in order, each once; a missing one is an error."""
    wanted = list(dict.fromkeys(columns))
    if missing := [c for c in wanted if c not in df.columns]:
        raise AbsorbiaError("data.missing_column", f"no column {missing}", stage="data", missing=missing)
    return df.select(*[F.col(f"`{c}`") for c in wanted])


def read(spark: SparkSession, source, columns: list[str] | None = None, schema: str | None = None, **options) -> DataFrame:
    """A DataFrame, a pandas frame, or a path ending in .csv, .txt, .dta, .parquet or .pq."""
    if bad := RESERVED & options.keys():
        raise AbsorbiaError("data.reader_option", f"{sorted(bad)} are set by the engine", stage="data")
    if isinstance(source, DataFrame):
        df = source
    elif isinstance(source, str):
        suffix = source.rstrip("/").rpartition(".")[2].lower()
        if suffix in ("parquet", "pq"):
            df = spark.read.options(**options).parquet(source)
        elif suffix in ("csv", "txt"):
            reader = spark.read.options(header=True, sep="\t" if suffix == "txt" else ",", **options)
            df = reader.schema(schema).csv(source) if schema else reader.option("inferSchema", True).csv(source)
        elif suffix == "dta":
            spark.dataSource.register(StataSource)
            df = spark.read.format("stata").options(**options).load(source)
        else:
            raise AbsorbiaError("data.source_type", f"no reader for .{suffix}", stage="data", suggestion=".csv, .txt, .dta, .parquet or .pq")
    elif hasattr(source, "dtypes"):
        df = spark.createDataFrame(source)
    else:
        raise AbsorbiaError("data.source_type", f"cannot read a {type(source).__name__}", stage="data")
    return df if columns is None else project(df, columns)


class StataSource(DataSource):
    """Stata files in ranges of rows, one a partition."""

    @classmethod
    def name(cls) -> str:
        return "stata"

    def schema(self):
        import pandas as pd

        with pd.read_stata(self.options["path"], chunksize=1, convert_categoricals=False) as reader:
            frame = next(iter(reader))
        kinds = {"i": "long", "u": "long", "f": "double", "b": "boolean", "M": "timestamp"}
        return ", ".join(f"`{c}` {kinds.get(frame[c].dtype.kind, 'string')}" for c in frame.columns)

    def reader(self, schema):
        return _StataReader(self.options["path"], schema)


class _StataReader(DataSourceReader):
    def __init__(self, path, schema):
        self.path, self.names = path, schema.names

    def partitions(self):
        import pandas as pd

        with pd.read_stata(self.path, chunksize=STATA_ROWS, columns=self.names[:1]) as reader:
            rows = sum(len(frame) for frame in reader)
        return [InputPartition(start) for start in range(0, max(rows, 1), STATA_ROWS)]

    def read(self, partition):
        import pandas as pd

        with pd.read_stata(self.path, chunksize=STATA_ROWS, convert_categoricals=False, columns=self.names) as reader:
            for i, frame in enumerate(reader):
                if i * STATA_ROWS == partition.value:
                    for row in frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None):
                        yield tuple(x.item() if hasattr(x, "item") else x for x in row)
                    return


def source_fingerprint(df: DataFrame) -> str:
    """A digest of schema and content that does not depend on row order."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h"), F.bit_xor(F.xxhash64(F.lit(1), *df.columns)).alias("x")).first()
    return hashlib.sha256(f"{df.schema.simpleString()}|{row['n']}|{row['h']}|{row['x']}".encode()).hexdigest()
