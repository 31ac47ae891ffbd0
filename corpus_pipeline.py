"""Corpus pipeline: quality, toxicity, near-duplicates, personal data, packing.

All stages but the last return the columns of their input, whatever these are called, and all its
rows but those they are meant to drop. Null and empty texts are scored, classed and packed as the
operators say. Equal rows stay or go together in the classifying stages; of rows that are copies
of each other, whatever their ids, near-duplicates keeps one. Rows without an id stay in it. An
empty table goes through all stages to no rows. Texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from absorbia.llm import nearcopies, packing, pii, quality, toxicity
from absorbia.llm.common import discard, fresh, materialize
from absorbia.llm.queries import held_out, tokenizer_path


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(5, 0))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    names = fresh(docs, "score", "predicted")
    return quality.classify(docs, _labels(spark, sf_dir), names=names).where(F.col(names[1]) == 1).drop(*names)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not call toxic."""
    names = fresh(docs, "score", "predicted")
    return toxicity.classify(docs, _labels(spark, sf_dir), names=names).where(F.col(names[1]) == 0).drop(*names)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each class of near copies (five-word Jaccard 0.8 or more); rows without an id stay.

    SimHash fingerprints are linked by covering anchors and the links checked on whole sets; copies
    beyond the reach of the anchors are found by prefixes.

    Rows are told apart by id and text: of a row that is there several times, id and text equal,
    any one is kept.
    """
    mark, = fresh(docs, "text_hash")
    classes = nearcopies.rooted(docs).where("doc_id is not null").groupBy("root", "doc_id", "text_hash").count()
    kept = materialize(classes.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash", "count")).alias("r")).select("r.*"), "kept")
    # the kept rows grow with the corpus: never broadcast, the same join at every size
    marked = docs.withColumn(mark, nearcopies.text_hash())
    out = marked.join(kept.select("doc_id", F.col("text_hash").alias(mark)).hint("merge"), ["doc_id", mark], "left_semi").select(*[F.col(f"`{c}`") for c in marked.columns])
    if not kept.where("count > 1").isEmpty():  # the same row again: one of them
        out = out.dropDuplicates(["doc_id", mark])
    return out.drop(mark).unionByName(docs.where(F.col("doc_id").isNull()))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced."""
    return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("near_duplicates", dedup_stage), ("pii", pii_stage), ("packing", packing_stage)]

#: The classifiers, the boosted trees and the packing cannot be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        made = materialize(stage(spark, docs, sf_dir), name)
        discard(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
