"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from absorbia.sources.scratch import discard, materialize

__all__ = ["bounded_ids", "claim", "crc_of_id", "discard", "documents", "fresh", "map_text", "materialize", "one_row_an_id", "pieces"]

_owner: tuple[str, Callable[[], None]] | None = None


def claim(name: str, clear: Callable[[], None]) -> None:
    """Make `name` the one operator whose memory this worker keeps; another's is cleared."""
    global _owner
    if _owner is not None and _owner[0] != name:
        _owner[1]()
    _owner = (name, clear)


def fresh(df: DataFrame, *names: str) -> tuple[str, ...]:
    """Names like those given that no column of df has, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_of_id(col) -> F.Column:
    """crc32 of an id as text; null ids count as 0 (never held out by a non-zero remainder rule)."""
    return F.coalesce(F.crc32(col.cast("string").cast("binary")), F.lit(0).cast("long"))


def pieces(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20, max_rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about max_bytes of `column`, at least one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if i > start and (total + size > max_bytes or i - start >= max_rows):
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        yield batch.slice(start)


def map_text(df: DataFrame, text_col: str, fields: list[tuple[str, str]], function: Callable[[], Callable], keep: list[str] | None = None, max_bytes: int = 4 << 20) -> DataFrame:
    """Append columns computed from a text column, in Arrow batches of bounded bytes.

    `function()` is called once per task and returns texts -> list of columns, one per field of
    `fields` (name, DDL type). `keep` names the columns to carry along (all by default); a kept
    column with the name of a new one is replaced by it.
    """
    names = [n for n, _ in fields]
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    source = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*kept, text_col])])
    drop_text = text_col not in kept
    out = T.StructType([f for f in source.schema.fields if not (drop_text and f.name == text_col)])
    new = T._parse_datatype_string(", ".join(f"`{n}` {t}" for n, t in fields))
    out = T.StructType([*out.fields, *new.fields])
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = [to_arrow_type(f.dataType) for f in new.fields]

    def run(batches):
        apply = function()
        for part in pieces(batches, text_col, max_bytes):
            texts = part.column(part.schema.get_field_index(text_col)).to_pylist()
            made = apply(texts)
            cols = [part.column(i) for i, n in enumerate(part.schema.names) if not (drop_text and n == text_col)]
            heads = [n for n in part.schema.names if not (drop_text and n == text_col)]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array(v, t) for v, t in zip(made, arrow))], names=[*heads, *names])

    return source.mapInArrow(run, out)


def one_row_an_id(df: DataFrame, id_col: str) -> DataFrame:
    """Of the rows of an id the least by all its other columns, in their order.

    Partial minima come before the shuffle, so an id of very many rows weighs on no task.
    """
    rest = [c for c in df.columns if c != id_col]
    return df.groupBy(id_col).agg(F.min(F.struct(*rest)).alias("_r")).select(id_col, "_r.*")


def bounded_ids(df: DataFrame, id_col: str, most: int, seed: int = 0) -> DataFrame:
    """At most `most` rows of df: those whose hashed id is smallest. Ties by id."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(id_col)), F.col(id_col)).limit(most)
