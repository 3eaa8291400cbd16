"""The corpus pipeline: quality, line dedup, near-duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again for the next one. All but the
last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusmill.llm import decontaminate, line_dedup, quality_crf, sentencepiece_codec, simhash
from corpusmill.llm.common import named, saved, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier takes for good."""
    return quality_crf.accepted(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that match an earlier line. Documents that had words and lose them all go; n_chars follows the text."""
    out = line_dedup.deduplicated(docs)
    out = out.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
    return out.select(named(docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id."""
    return simhash.deduplicated(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, their number, and whether they decode to its text."""
    model = sentencepiece_codec.broadcast_model(spark)
    return sentencepiece_codec.encoded(docs.select("doc_id", "text"), model, check=True).select("doc_id", "input_ids", "n_tokens", "round_trip")


STAGES = [
    ("quality", quality),
    ("line_dedup", dedup_lines),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate_benchmark),
    ("tokenize", tokenize),
]

#: The classifier's weights can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
