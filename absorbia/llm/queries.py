"""Queries of the training-data operators over the intended tables, whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, bpe, digest, langid, licenses, packing, pii, quality, simhash, toxicity
from .common import crc_of_id, documents


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(modulus: int, remainder: int):
    return (F.pmod(crc_of_id(F.col("doc_id")), F.lit(modulus)) == remainder) & F.col("doc_id").isNotNull()


def _ids_and_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", "text")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_ids_and_texts(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _ids_and_texts(spark, sf_dir)
    scored = quality.classify(docs, _labels(spark, sf_dir).where(~held_out(5, 0)), keep=["doc_id"])
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_ids_and_texts(spark, sf_dir))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_ids_and_texts(spark, sf_dir))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_ids_and_texts(spark, sf_dir), keep=["doc_id"])


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~held_out(3, 1)))
    return langid.identify(docs, model, keep=["doc_id"]).select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_ids_and_texts(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), keep=["doc_id"])


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.neighbours(_ids_and_texts(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _ids_and_texts(spark, sf_dir)
    return toxicity.classify(docs, _labels(spark, sf_dir).where(~held_out(5, 0)), keep=["doc_id"]).select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return ann.search(rows, rows.where(F.pmod(F.col("vec_id"), F.lit(100)) == 0))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_packing, op2_quality, op3_simhash, op4_pii, op5_licenses, op6_language, op7_bpe, op8_fingerprints, op9_toxicity, op10_neighbours, pipeline)}

#: None of these can be put in SQL whole: each rests on a fitted model, a tokenizer or a packing.
ORACLE_SQL: dict[str, str] = {}
