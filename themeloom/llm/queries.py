"""The operators over their whole tables, as queries of ``(spark, sf_dir)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, langid, licenses, mixing, packing, quality, secrets, simhash, toxicity, warc

#: Sources by name, the weight of each further one, and the budget in tokens of the whole table.
TARGETS = {"targets": {"src0": 0.12, "src1": 0.10, "src2": 0.02}, "other": 0.045, "total": 1.0}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, from the WARC files that the table is written to."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that the quality rules keep, with its score."""
    docs = table(spark, sf_dir, "documents")
    return quality.kept_scores(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 2,048 tokens that hold all documents, with their texts."""
    return packing.pack(table(spark, sf_dir, "documents"), texts=True)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that is found toxic."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxic_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every confirmed secret of every document."""
    return secrets.scan(table(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items that its digest overlaps, the class of documents that it belongs to and its number of links, features ranked by the whole corpus."""
    docs = table(spark, sf_dir, "documents")
    return fingerprints.linked(docs, fingerprints.histogram(docs), table(spark, sf_dir, "benchmark"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family and language of every document."""
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license that a document grants."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that has near copies, with its group."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that the target weights take, a row for each time."""
    weights = mixing.quality_weights(table(spark, sf_dir, "labels"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.token_estimate(F.col("text")).alias("tokens"), F.xxhash64("text").alias("hash"))
    return mixing.mix(docs, **TARGETS, weights=weights, tokens=F.col("tokens"), tie=F.col("hash")).drop("hash")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op2_quality, op3_packing, op4_toxicity, op5_secrets, op6_fingerprints, op7_langid, op8_licenses, op9_simhash, op10_mixing)}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": "SELECT page_id, url, html, 'ok' AS status FROM pages", "op10_mixing": mixing.mix_sql(**TARGETS)}
