"""Inverse operators: resolving references, rehydration (INV-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import apply_patch
from .filters import ai_lines

REF = r"(\$[A-Za-z0-9_]+)"


def resolve(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """INV-01: references by whole token, so that ``$PK1`` is never read as ``$P``; unknown ones stay."""
    names = dictionary.select(F.col("token").alias("value"), F.col("value").alias("_v"))
    return tokens.join(names, "value", "left").withColumn("value", F.when((F.col("kind") == "ref") & F.col("_v").isNotNull(), F.col("_v")).otherwise(F.col("value"))).drop("_v")


def expand(dictionary: DataFrame, rounds: int = 10) -> DataFrame:
    """INV-02: the dictionary with references inside values expanded, ten rounds at most; one join a round, none once nothing is left."""
    current = dictionary.select("token", "value")
    for _ in range(rounds):
        open_ = current.select("token", "value", F.explode(F.array_distinct(F.regexp_extract_all("value", F.lit(REF), F.lit(1)))).alias("ref")).join(
            dictionary.select(F.col("token").alias("ref"), F.col("value").alias("to")), "ref")
        edits = open_.groupBy("token").agg(F.array_sort(F.collect_list(F.struct((-F.length("ref")).alias("n"), "ref", "to"))).alias("edits"))
        if edits.isEmpty():
            break
        current = current.join(edits, "token", "left").select("token", F.when(F.col("edits").isNull(), F.col("value")).otherwise(F.aggregate("edits", F.col("value"), lambda acc, e: F.replace(acc, e["ref"], e["to"]))).alias("value"))
    return current


def resolve_for_ai(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """INV-03: macros that speak of errors and paths are put in, directories stay, other macros go and are counted (dropped = 1)."""
    names = dictionary.select(F.col("token").alias("value"), F.col("value").alias("_v"))
    df = tokens.join(names, "value", "left")
    macro = (F.col("kind") == "ref") & F.col("value").rlike(r"^\$M[0-9]")
    telling = F.lower("_v").rlike("error|fail|exception|warning")
    drop = macro & ~F.coalesce(telling, F.lit(False))
    plain = (F.col("kind") == "ref") & F.col("_v").isNotNull() & ~F.col("value").startswith("$D")
    return df.select("source_id", "seq", F.when(drop, "dropped").when(plain, "text").otherwise(F.col("kind")).alias("kind"), F.when(drop, "").when(plain, F.col("_v")).otherwise(F.col("value")).alias("value"), drop.cast("int").alias("dropped"))


def assemble(tokens: DataFrame) -> DataFrame:
    """INV-04: each source's text, in order."""
    return tokens.groupBy("source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"]), "\n").alias("text"))


def rehydrate_for_ai(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """INV-05: resolved for AI, then only the telling lines."""
    kept = resolve_for_ai(tokens, dictionary).where("dropped = 0").select("source_id", F.col("seq").alias("line_no"), F.col("value").alias("line"))
    return ai_lines(kept)


def restore_marks(text: Column, base_timestamp: Column | None = None) -> Column:
    """INV-04/05: ``$PL`` as ``[Pipeline]``, and a note on what relative times refer to where there is a base."""
    out = F.replace(text, F.lit("$PL"), F.lit("[Pipeline]"))
    return out if base_timestamp is None else F.concat(F.when(base_timestamp.isNotNull(), F.concat(F.lit("Note: [T+Xms] are relative to Base Timestamp "), base_timestamp, F.lit("\n\n"))).otherwise(""), out)


def restore_fuzzy(df: DataFrame, base: str, patch: str, out: str = "text") -> DataFrame:
    """INV-06: fuzzy duplicates from their base and patch."""
    return df.withColumn(out, apply_patch(F.col(base), F.col(patch)))


def ai_export(texts: DataFrame, dirs: DataFrame, header: bool = True) -> DataFrame:
    """SNK-04: (source_id, text) with the directory block in front; ``header=False`` leaves both headings out."""
    listed = dirs.select(F.regexp_extract("token", "([0-9]+)", 1).cast("bigint").alias("k"), F.concat_ws(": ", "token", "value").alias("v")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]), "\n").alias("dirs"))
    if not header:
        return texts
    # one row: the directory dictionary as a whole
    return texts.crossJoin(F.broadcast(listed)).select("source_id", F.concat(F.lit("[Directories]\n"), "dirs", F.lit("\n[Semantic Logs]\n"), "text").alias("text"))
