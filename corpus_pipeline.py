"""The corpus pipeline: each stage's result is written as Parquet and is the next one's input.

Defined results of every stage: null and empty texts are documents without words; rows with a null id stay unless the
classifier rejects them; a document that repeats (same id and text) stays once; an empty table gives no rows; extra
columns come through as they are, whatever their names.

What a stage writes has no file for each partition that Spark happens to deal, but one for each FILE documents that the stage is
given, or for each core where these are more."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textsieve.llm import decontaminate, line_dedup, near_dedup, quality, sentencepieces
from textsieve.llm.common import FILE, cut, few, table


def _as_documents(df: DataFrame, docs: DataFrame) -> DataFrame:
    """docs' columns, with n_chars (where there is one) of the text as it is now."""
    if "n_chars" not in docs.columns:
        return df
    return df.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("bigint")).select(*docs.columns)


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns in one, so that no name of theirs can meet one of an operator's."""
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]).alias("_rest"))


def _unpacked(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"_rest.`{c}`").alias(c) for c in docs.columns])


def _files(docs: DataFrame) -> int:
    return -(-docs.count() // FILE)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return few(quality.accepted(docs, table(spark, sf_dir, "labels")), _files(docs))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, the one with the smallest id."""
    return few(_unpacked(near_dedup.keep_first(_packed(docs)), docs), _files(docs))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go; documents of which nothing is left go with them."""
    files = _files(docs)
    made = line_dedup.dedup(_packed(docs), min_run=line_dedup.MIN_RUN, files=files)
    return few(_as_documents(_unpacked(made.where((F.col("n_removed") == 0) | (F.trim(F.coalesce("text", F.lit(""))) != "")), docs), docs), files)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items go."""
    files = _files(docs)
    return few(_unpacked(decontaminate.clean(_packed(docs), table(spark, sf_dir, "benchmark"), files=files), docs), files)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids."""
    return few(sentencepieces.encode(docs), _files(docs))


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_stage),
    ("substring_dedup", substring_stage),
    ("decontaminate", decontamination_stage),
    ("sentencepiece", sentencepiece_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
