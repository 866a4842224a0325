"""Sinks and renderings (SNK-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.inverse import assemble


def to_json(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """SNK-01: one JSON object a source: its tokens, and the entries it refers to."""
    refs = tokens.where("kind = 'ref'").select("source_id", F.col("value").alias("token")).distinct().join(dictionary.select("token", "value"), "token")
    entries = refs.groupBy("source_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("token", "value")))).alias("dictionary"))
    body = tokens.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "value"))).alias("tokens"), F.count(F.lit(1)).alias("n"))
    return body.join(entries, "source_id", "left").select("source_id", F.to_json(F.struct("tokens", "dictionary", F.struct(F.col("n").alias("n_tokens")).alias("metadata"))).alias("json"))


def payload(tokens: DataFrame) -> DataFrame:
    """SNK-02: each source's text, references as they are."""
    return assemble(tokens)


def llm_payload(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """SNK-03: ``[DICT]`` with the entries a source refers to, then ``[DATA]``."""
    refs = tokens.where("kind = 'ref'").select("source_id", F.col("value").alias("token")).distinct().join(dictionary.select("token", "value"), "token")
    entries = refs.groupBy("source_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "token", "value"))), "\n").alias("d"))
    return assemble(tokens).join(entries, "source_id", "left").select("source_id", F.concat(F.lit("[DICT]\n"), F.coalesce("d", F.lit("")), F.lit("\n[DATA]\n"), "text").alias("text"))


def merge_outputs(chunks: DataFrame) -> DataFrame:
    """SNK-05 / STR-07: chunk summaries (source_id, original_size, compressed_size, base_timestamp, chunk) as one: sums, and the first base."""
    return chunks.groupBy("source_id").agg(
        F.sum("original_size").alias("original_size"), F.sum("compressed_size").alias("compressed_size"),
        F.min_by("base_timestamp", F.when(F.col("base_timestamp").isNotNull(), F.col("chunk"))).alias("base_timestamp")
    ).withColumn("ratio", F.when(F.col("original_size") == 0, 0.0).otherwise(F.round(F.col("compressed_size") / F.col("original_size"), 6)))


def record(events: DataFrame, path: str) -> None:
    """SNK-06: appends events, a folder for each day."""
    events.withColumn("day", F.to_date("timestamp")).write.mode("append").partitionBy("day").parquet(path)


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """SNK-07: rows and bytes that pass by, without a second job."""
    o = Observation(name)
    return df.observe(o, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).alias("bytes")), o


def metrics_text(metrics: dict, prefix: str = "textsieve") -> str:
    """SNK-07: the text form that scrapers read."""
    return "".join(f"# TYPE {prefix}_{k} counter\n{prefix}_{k} {v}\n" for k, v in sorted(metrics.items()))


def tee(df: DataFrame, path: str) -> DataFrame:
    """SNK-08: the raw rows, kept beside."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_lines(df: DataFrame, path: str, column: str = "line") -> None:
    df.select(F.col(column).alias("value")).write.mode("errorifexists").option("compression", "gzip").text(path)
