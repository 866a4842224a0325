"""Context keys and stable regrouping (ORD-*), top-k (TOP-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import normalize_line, words
from . import scan
from .reduce import shorten_paths

# Fixed values: (name, pattern, group).
RULES = (
    ("xcode_task", r"^[A-Z][a-zA-Z0-9_]+[ \t]+.*\(in target '([^']+)'", 1),
    ("make_id", r"make\[([0-9]+)\]", 1),
    ("shell_trace", r"^\+ ([A-Za-z0-9_-]+)", 1),
    ("android_log", r"^[0-9]+-[0-9]+[ \t]+[0-9]+:[0-9]+:[0-9]+\.[0-9]+[ \t]+([0-9]+)", 1),
    ("bracket_tag", r"^\[([a-zA-Z0-9_-]+)\]", 1),
)
TOOLS = r"gcc|g\+\+|clang|cc|c\+\+|cl\.exe|link\.exe|lib\.exe|ld |ar |javac|d8|r8|aapt2|jar |rustc|cargo |go build|go run|swiftc"
SOURCES = r"\.(c|cpp|cc|cxx|m|mm|java|kt|o|obj|swift|rs|go)$"


def is_continuation(line: Column) -> Column:
    return F.ltrim(line).startswith("|") | F.ltrim(line).startswith("^") | line.startswith("    ")


def build_target(line: Column) -> Column:
    """The output (or else the source) of a compiler, linker or archiver call. The last output and the first source of a line count."""
    w = words(line)
    out = F.array_compact(F.transform(w, lambda p, i: F.when(p.isin("-o", "--output", "-out") & (i + 1 < F.size(w)), F.get(w, i + 1))
                                      .when(F.lower(p).startswith("/out:"), F.substring(p, 6, 10_000))
                                      .when(F.lower(p).rlike("^/f[oe]") & (F.length(p) > 3), F.substring(p, 4, 10_000))
                                      .when(p.rlike("^-o.") & ~p.isin("-out"), F.substring(p, 3, 10_000))
                                      .when(F.get(w, F.lit(0)).rlike(r"(^ar|ar\.exe)$") & p.rlike("^(cr|rc)") & (i + 1 < F.size(w)), F.get(w, i + 1))
                                      .when(F.get(w, F.lit(0)).rlike(r"(^jar|jar\.exe)$") & p.rlike("^(cf|cvf)") & (i + 1 < F.size(w)), F.get(w, i + 1))))
    src = F.filter(w, lambda p: F.lower(p).rlike(SOURCES))
    o, s = F.get(out, F.size(out) - 1), F.get(src, F.lit(0))
    key = F.when(o.isNotNull() & s.isNotNull(), F.concat(F.lit("build_target:"), o, F.lit("|"), s)).when(o.isNotNull(), F.concat(F.lit("build_target:"), o)).when(s.isNotNull(), F.concat(F.lit("build_target:"), s))
    return F.when(F.lower(line).rlike(TOOLS), key)


def own_key(line: Column) -> Column:
    keys = [build_target(line)]
    for name, pattern, group in RULES:
        keys.append(F.when(line.rlike(pattern), F.concat(F.lit(name + ":"), F.regexp_extract(line, pattern, group))))
    return F.when(~is_continuation(line), F.coalesce(*keys))


def context_keys(lines: DataFrame, key: Column | None = None, sticky: bool = True) -> DataFrame:
    """ORD-01: every line's context: its own key, or the last one before it (always for continuations)."""
    own = own_key(F.col("line")) if key is None else key
    if not sticky:
        own = F.when(is_continuation(F.col("line")), F.lit(None)).otherwise(F.coalesce(own, F.lit("default")))
    return scan.forward_fill(lines, own, "context", ["source_id"]).withColumn("context", F.coalesce("context", F.lit("default")))


def regroup(keyed: DataFrame) -> DataFrame:
    """ORD-02: new places by (context, old place) in each source. The count of earlier contexts' lines is summed over contexts, and ranks are taken inside each context."""
    sizes = keyed.groupBy("source_id", "context").agg(F.count(F.lit(1)).alias("_n"))
    return _placed(keyed, sizes.withColumn("_k", F.struct("context")))


def regroup_by_appearance(keyed: DataFrame) -> DataFrame:
    """ORD-03: contexts in the order of their first lines."""
    sizes = keyed.groupBy("source_id", "context").agg(F.count(F.lit(1)).alias("_n"), F.min("line_no").alias("_m"))
    return _placed(keyed, sizes.withColumn("_k", F.struct("_m")).drop("_m"))


def _placed(keyed: DataFrame, sizes: DataFrame) -> DataFrame:
    start = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(Window.partitionBy("source_id").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n", "_k")
    own = scan.running_sum(keyed, F.lit(1), "_r", ["source_id", "context"])
    return own.join(start, ["source_id", "context"]).withColumn("place", (F.col("_start") + F.col("_r")).cast("bigint")).drop("_r", "_start")


def log_reorder(lines: DataFrame) -> DataFrame:
    """ORD-05: normalised, shortened and regrouped lines."""
    clean = lines.withColumn("line", shorten_paths(normalize_line(F.col("line"))))
    return regroup(context_keys(clean))


def top_counts(df: DataFrame, value: str, n: int, by: list[str] | None = None) -> DataFrame:
    """TOP-01: the n most frequent values (count desc, value asc), for each group if any."""
    by = by or []
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    if not by:
        return counts.orderBy(F.desc("n"), value).limit(n)
    return counts.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), value))).where(F.col("_r") <= n).drop("_r")


def longest_first(dictionary: DataFrame) -> DataFrame:
    """TOP-03."""
    return dictionary.orderBy(F.desc(F.octet_length("value")), "value")
