"""Line filters (FLT-*): predicates, context windows, sections, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan

# Fixed values.
KEYWORDS = ("gcc", "g++", "make[", "error:", "warning:", "note:", "at ", "Traceback", "Exception", "Caused by:", "{", "[", "http", "https", "diff --git", "--- ", "+++ ", "SELECT", "INSERT", "UPDATE", "DELETE", "/", "\\", ".", "-", "_", ":")
TRIGGERS = ("error", "warning", "fail", "fatal", "exception")
METADATA = ("branch", "commit", "exit code", "return code", "duration", "elapsed", "cost time", "耗时")
DIFF_HEADERS = ("--- ", "+++ ", "*** ", "=== ", "Index: ", "diff --git ", "diff -r ", "rename from ", "rename to ", "copy from ", "copy to ")
HIDDEN = (("​", "ZERO WIDTH SPACE"), ("‌", "ZERO WIDTH NON-JOINER"), ("‍", "ZERO WIDTH JOINER"), ("﻿", "ZERO WIDTH NO-BREAK SPACE"), ("‮", "RIGHT-TO-LEFT OVERRIDE"))
INJECTIONS = ("ignore previous instructions", "ignore all previous instructions", "disregard previous", "you are now", "system prompt", "developer instructions")
SHELL = ("&&", "||", ";", "|", ">", "<", "`", "$(")


def quote(text: str) -> str:
    """A literal inside a regular expression of either engine."""
    return "".join("\\" + c if c in "\\.[]{}()*+?^$|" else c for c in text)


def contains_any(text: Column, needles: tuple[str, ...]) -> Column:
    return text.rlike("|".join(map(quote, needles)))


def is_quick_skip(text: Column) -> Column:
    """FLT-01: short texts without any keyword; the length is tested first."""
    return (F.octet_length(text) < 1000) & ~contains_any(text, KEYWORDS)


def is_trigger(line: Column) -> Column:
    return F.lower(line).rlike("|".join(TRIGGERS))


def is_self_only(line: Column) -> Column:
    return (
        line.startswith("==========") | line.startswith("[Directories]") | line.startswith("[Semantic Logs]") | line.startswith("Note: [T+")
        | (line.startswith("$D") & F.contains(line, F.lit(": "))) | F.lower(line).rlike("|".join(METADATA))
    )


def ai_lines(lines: DataFrame) -> DataFrame:
    """FLT-02: triggers with a line on either side, and metadata lines; each run of others is one row.

    Neighbours are found by joining keys (source_id, line rank), never by ordering a source in one task."""
    ranked = scan.running_sum(lines, F.lit(1), "rank", ["source_id"])
    near = ranked.where(is_trigger(F.col("line"))).select("source_id", F.explode(F.array(F.col("rank") - 1, F.col("rank"), F.col("rank") + 1)).alias("rank")).distinct().withColumn("near", F.lit(True))
    kept = ranked.join(near, ["source_id", "rank"], "left").withColumn("keep", F.coalesce("near", F.lit(False)) | is_self_only(F.col("line"))).drop("near")
    runs = scan.running_sum(kept, F.col("keep").cast("int"), "run", ["source_id"])
    shown = runs.where("keep").select("source_id", "line_no", "line")
    skipped = runs.where("not keep").groupBy("source_id", "run").agg(F.min("line_no").alias("line_no"), F.count(F.lit(1)).alias("n"))
    return shown.unionByName(skipped.select("source_id", "line_no", F.format_string("... Skipped %d normal build lines ...", "n").alias("line")))


def keep_drop(line: Column, keep: list[str], drop: list[str]) -> Column:
    """FLT-03: drop wins; an empty keep list keeps all."""
    out = F.lit(True) if not keep else line.rlike("|".join(f"(?:{k})" for k in keep))
    return out & ~line.rlike("|".join(f"(?:{d})" for d in drop)) if drop else out


def section(lines: DataFrame, enter: str, exit_: str | None) -> DataFrame:
    """FLT-04: the lines of a section, without those that open or close it.

    The state after a line is that of its last marker; a line that opens while the section is open is content. A line
    that matches both patterns closes an open section and opens a closed one: such lines are resolved by their parity."""
    opens, closes = F.col("line").rlike(enter), F.col("line").rlike(exit_) if exit_ else F.lit(False)
    mark = F.when(opens & closes, "x").when(opens, "o").when(closes, "c")
    df = scan.forward_fill(lines.withColumn("_m", mark), F.when(F.col("_m").isin("o", "c"), F.col("line_no")), "_at", ["source_id"])
    df = scan.running_sum(df, F.when(F.col("_m") == "x", 1).otherwise(0), "_flips", ["source_id"])
    base = df.where(F.col("_m").isin("o", "c")).select("source_id", F.col("line_no").alias("_at"), (F.col("_m") == "o").alias("_base"), F.col("_flips").alias("_before"))
    after = df.join(base, ["source_id", "_at"], "left").withColumn("_open", F.coalesce("_base", F.lit(False)) != ((F.col("_flips") - F.coalesce("_before", F.lit(0))) % 2 == 1))
    was = scan.previous(after, F.col("_open"), "_was", ["source_id"]).withColumn("_was", F.coalesce("_was", F.lit(False)))
    return was.where(F.col("_was") & ~F.coalesce(F.col("_m").isin("c", "x"), F.lit(False))).select("source_id", "line_no", "line")


def collapse_blank(lines: DataFrame) -> DataFrame:
    """FLT-05: the first blank line of a run."""
    df = scan.previous(lines, F.trim("line") == "", "_blank", ["source_id"])
    return df.where(~(F.coalesce("_blank", F.lit(False)) & (F.trim("line") == ""))).drop("_blank")


def is_noise(line: Column) -> Column:
    """FLT-06."""
    from ..functions.normalize import NOISE_PREFIXES

    return line.rlike("^(" + "|".join(NOISE_PREFIXES) + ")")


def is_diff_header(line: Column) -> Column:
    """FLT-07."""
    return F.ltrim(line).rlike("^(" + "|".join(map(quote, DIFF_HEADERS)) + ")")


def is_error(line: Column) -> Column:
    """FLT-08."""
    return F.lower(line).rlike("error|fatal|panic|failed|rollback")


def keep_error_signal(raw: Column, compacted: Column) -> Column:
    """FLT-09: if the raw text has an error line and the compacted one none, the first such line is appended."""
    signal = "error|fatal|panic"
    first = F.get(F.filter(F.split(raw, "\n"), lambda x: F.lower(x).rlike(signal)), F.lit(0))
    return F.when(F.lower(raw).rlike(signal) & ~F.lower(compacted).rlike(signal), F.concat_ws("\n", compacted, first)).otherwise(compacted)


def prefer_smaller(raw: Column, compacted: Column) -> Column:
    """FLT-10: the raw text if the other one is longer, trimmed or not."""
    return F.when((F.octet_length(F.trim(compacted)) > F.octet_length(F.trim(raw))) | (F.octet_length(compacted) > F.octet_length(raw)), raw).otherwise(compacted)


def head_tail(lines: DataFrame, n: int = 5) -> DataFrame:
    """FLT-11: sources of more than 2n lines keep the first and last n, with a marker between."""
    ranked = scan.running_sum(lines, F.lit(1), "rank", ["source_id"])
    total = ranked.groupBy("source_id").agg(F.max("rank").alias("total"))
    df = ranked.join(total, "source_id")
    ends = df.where(f"total <= {2 * n} or rank <= {n} or rank > total - {n}").select("source_id", "rank", "line")
    mark = total.where(f"total > {2 * n}").select("source_id", F.lit(n + 1).cast("bigint").alias("rank"), F.format_string(f"... %d lines omitted ...", F.col("total") - 2 * n).alias("line"))
    return ends.unionByName(mark)


def safety_warnings(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """FLT-12: one row for each pattern that a text holds."""
    t = F.col(text)
    checks = [("hidden_unicode", f"W_SAFETY_HIDDEN_UNICODE:{label}", F.contains(t, F.lit(c))) for c, label in HIDDEN]
    checks += [("prompt_injection", f"W_SAFETY_PROMPT_INJECTION:{p}", F.contains(F.lower(t), F.lit(p))) for p in INJECTIONS]
    checks += [("shell_injection", f"W_SAFETY_SHELL_META:{p}", F.contains(t, F.lit(p))) for p in SHELL]
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(n).alias("check"), F.lit(m).alias("message"))) for n, m, c in checks]))
    return df.select(key, F.explode(found).alias("w")).select(key, "w.check", "w.message")


def adjacent_unique(lines: DataFrame) -> DataFrame:
    """VCS-X2: drops a line that equals the one before."""
    df = scan.previous(lines, F.col("line"), "_prev", ["source_id"])
    return df.where(~F.col("line").eqNullSafe(F.col("_prev"))).drop("_prev")
