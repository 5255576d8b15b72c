"""Cleans a corpus in stages; each stage's output is written and read by the next one.

Rows may repeat and any column may be NULL; an empty corpus passes through all stages. Texts that
are NULL or hold no letter leave in the first stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.llm import languages, lines, near, pieces, templates
from cutline.session import materialise

# A document in which no language reaches this share is rejected.
LEAST_SHARE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with one prevailing language, as learned from the labelled ones."""
    model = languages.train(docs.filter(~languages.held_out()))
    found = languages.detect(docs, model)
    kept = found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE))
    return kept.select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; a document that loses all its lines goes (each of them
    stays in the document that had it first)."""
    left = lines.deduplicate(docs)
    left = left.filter((F.col("n_lines") == 0) | (F.col("n_removed") < F.col("n_lines")))
    length = F.when(F.col("n_removed") > 0, F.length("text").cast("long"))
    return left.withColumn("n_chars", F.coalesce(length, F.col("n_chars"))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near.documents(docs).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return templates.decontaminate(docs, items).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, their number, and whether they decode to the text."""
    coded = pieces.decode(pieces.encode(docs.select("doc_id", "lang", "source", "text")))
    return coded.select(
        "doc_id",
        "lang",
        "source",
        F.size("ids").cast("long").alias("n_tokens"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
        "ids",
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("encode", encode),
]

# Trained models, sketches and tokenizers cannot be stated in SQL: see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
