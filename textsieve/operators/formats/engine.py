"""How a format is described, and what every format can do.

A format is data: how sure a text is of it (``detect``), which lines are records (``records``: a kind, a
pattern and the groups that are its fields), which lines set a context for those that follow (``context``),
and by what records are counted (``by``). Parsing is one projection, contexts are forward-filled over chunks,
and summaries are one aggregation with partial sums."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scan

FIELDS = ("key", "value", "level", "file", "ln", "msg")


@dataclass(frozen=True)
class Record:
    kind: str
    pattern: str
    fields: dict  # field -> group number or constant text


@dataclass(frozen=True)
class Format:
    name: str
    order: int
    detect: Callable[[Column], Column]
    records: tuple[Record, ...] = ()
    context: str | None = None  # its first group is the context of the lines below
    by: tuple[str, ...] = ("kind", "key", "level")
    trim: bool = True


def share(text: Column, pattern: str, lines: int) -> Column:
    """The share of a text's first lines that fit a pattern."""
    head = F.filter(F.slice(F.split(text, "\n", lines + 1), 1, lines), lambda x: F.trim(x) != "")  # the rest of the text is not split
    return F.size(F.filter(head, lambda x: x.rlike(pattern))) / F.greatest(F.size(head), F.lit(1))


def has(text: Column, *needles: str, score: float = 0.9) -> Column:
    from ..filters import contains_any

    return F.when(contains_any(F.lower(text), tuple(n.lower() for n in needles)), score).otherwise(0.0)


def parse(lines: DataFrame, fmt: Format) -> DataFrame:
    """(source_id, line_no, context, kind, key, value, level, file, ln, msg): the record lines; the first record that fits wins."""
    line = F.trim("line") if fmt.trim else F.col("line")
    branches = []
    for r in fmt.records:
        get = lambda f, r=r: F.lit("") if f not in r.fields else F.lit(r.fields[f]) if isinstance(r.fields[f], str) else F.regexp_extract(line, r.pattern, r.fields[f])
        branches.append(F.when(line.rlike(r.pattern), F.struct(F.lit(r.kind).alias("kind"), *[get(f).alias(f) for f in FIELDS])))
    df = lines.withColumn("_r", F.coalesce(*branches))
    if fmt.context:
        df = scan.forward_fill(df, F.when(line.rlike(fmt.context), F.regexp_extract(line, fmt.context, 1)), "context", ["source_id"])
    else:
        df = df.withColumn("context", F.lit(None).cast("string"))
    return df.where("_r is not null").select("source_id", "line_no", F.coalesce("context", F.lit("")).alias("context"), "_r.*")


def summarize(records: DataFrame, fmt: Format) -> DataFrame:
    """(source_id, *by, n, total, first_line): counts, and sums of the values that are numbers."""
    return records.groupBy("source_id", *fmt.by).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("value").try_cast("double")), F.lit(0.0)).alias("total"), F.min("line_no").alias("first_line"))


def signals(records: DataFrame, most: int, *kinds: str) -> DataFrame:
    """The first records of some kinds of each source."""
    w = Window.partitionBy("source_id").orderBy("line_no")
    return records.where(F.col("kind").isin(*kinds)).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def fold_runs(lines: DataFrame, member: Column, least: int, label: str) -> DataFrame:
    """Runs of more than ``least`` consecutive lines that fit become one line ``label`` (with %d for the count)."""
    df = scan.running_sum(lines.withColumn("_in", member), F.when(F.col("_in"), 0).otherwise(1), "_run", ["source_id"])
    runs = df.where("_in").groupBy("source_id", "_run").agg(F.count(F.lit(1)).alias("_n"), F.min("line_no").alias("_first")).where(F.col("_n") > least)
    joined = df.join(runs, ["source_id", "_run"], "left")
    folded = F.col("_in") & F.col("_n").isNotNull()
    return joined.where(~folded | (F.col("line_no") == F.col("_first"))).select("source_id", "line_no", F.when(folded, F.format_string(label, "_n")).otherwise(F.col("line")).alias("line"))


def keep_first(records: DataFrame, by: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` records of each group, and the counts of the rest."""
    w = Window.partitionBy("source_id", *by).orderBy("line_no")
    kept = records.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")  # the limit reaches the rows before their shuffle
    more = records.groupBy("source_id", *by).agg((F.count(F.lit(1)) - most).alias("more")).where("more > 0")
    return kept, more


def blocks(lines: DataFrame, head: str) -> DataFrame:
    """Adds block: the number of header lines up to the line (0 before the first)."""
    return scan.running_sum(lines, F.when(F.col("line").rlike(head), 1).otherwise(0), "block", ["source_id"])
