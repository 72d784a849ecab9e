"""Corpus preparation: documents in, a weighted training mix out.

Each stage takes ``(spark, docs, sf_dir)``; it is written as Parquet and read again as the
next one's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, minhash, mixing, pii, quality
from tidemark.llm.common import save


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the best grade (good and not toxic) is high enough stay; the model is fitted on the rated documents.

    Null and empty texts are scored by their shape; rows that repeat score alike, so they go or
    stay together. Without ratings all stay. Empty input: no rows.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, quality.graded(labels))
    return quality.score(docs, model).where(F.col("p_best") >= quality.KEEP).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document with the least id stays.

    Null, empty and blank texts are no copies of each other and stay, as do rows without an id.
    Rows that repeat an id go or stay together. Empty input: no rows.
    """
    found = minhash.near_duplicates(docs, k=5, percent=80)
    lost = found.where("not kept and component_id <> doc_id").select("doc_id").distinct()
    return docs.join(lost.hint("shuffle_hash"), "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go.

    Null or empty texts hold none and stay, null ids are judged like others. Rows that share an
    id are judged by their own texts; equal rows go or stay together. Empty input or benchmark:
    nothing goes.
    """
    row = F.struct("doc_id", F.xxhash64("text").alias("text"))
    found = decontaminate.leaks(docs.select(row.alias("row"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="row")
    gone = found.select(F.col("doc_id.doc_id").alias("id"), F.col("doc_id.text").alias("h")).distinct()
    return docs.join(gone.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(gone["id"]) & (F.xxhash64("text") == gone["h"]), "left_anti").select(docs.columns)


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to the name of their kind; ``n_chars`` follows the text.

    A null text stays null (and so does its count), an empty one empty; repeated rows change
    alike. Empty input: no rows.
    """
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies and words that each remaining document gives to the mix.

    Null text: size 0. Null source: a source of its own, last. Rows that repeat are drawn one by
    one. Empty input: no rows.
    """
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_filter),
    ("minhash_near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("pii", pii_redaction),
    ("mixing", mixing_stage),
]

#: Rounding draws and verification by shared-folder steps have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = save(docs)
    return docs
