"""What single formats compute beyond counting records."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...functions import normalize as N
from .. import filters, reduce, scan
from . import engine

cloudpickle.register_pickle_by_value(sys.modules[__name__])

GO = "struct<Action:string,Package:string,Test:string,Elapsed:double>"


def go_test(lines: DataFrame) -> DataFrame:
    """PLG-05: (source_id, package, passed, failed, skipped, slow, failed_tests): the last verdict of each test; a null package is the total."""
    e = lines.select("source_id", "line_no", F.from_json("line", GO).alias("e")).select("source_id", "line_no", "e.*").where("Test is not null and Action in ('pass', 'fail', 'skip')")
    last = e.groupBy("source_id", "Package", "Test").agg(F.max_by(F.struct("Action", "Elapsed"), "line_no").alias("v")).select("source_id", F.col("Package").alias("package"), "Test", "v.*")
    aggs = [F.count_if(F.col("Action") == a).alias(n) for a, n in (("pass", "passed"), ("fail", "failed"), ("skip", "skipped"))]
    return last.rollup("source_id", "package").agg(*aggs, F.count_if((F.col("Action") == "pass") & (F.col("Elapsed") > 1)).alias("slow"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("Action") == "fail", F.col("Test")))), ",").alias("failed_tests")).where("source_id is not null")


def db_durations(lines: DataFrame, fmt, slow: float = 100.0) -> DataFrame:
    """PLG-03: durations by statement skeleton: count, average, largest, slow ones."""
    r = engine.parse(lines, fmt).where("kind = 'pg_duration'").withColumn("ms", F.col("value").try_cast("double")).withColumn("stmt", N.trim_to(F.regexp_replace(F.regexp_replace("msg", "'[^']*'", "'?'"), r"\b[0-9]+\b", "?"), 120))
    return r.groupBy("stmt").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ms"), 3).alias("avg_ms"), F.max("ms").alias("max_ms"), F.count_if(F.col("ms") >= slow).alias("slow"))


def ci_summary(lines: DataFrame, fmt) -> tuple[DataFrame, DataFrame]:
    """PLG-33: (summary by source, steps by source): lines before the first step belong to ``job``; at most six steps that failed or warned, or any."""
    r = engine.parse(lines.where(F.trim("line") != ""), fmt).where("kind not in ('step', 'end')").withColumn("step", F.when(F.col("context") == "", "job").otherwise(F.col("context")))
    count = lambda k: F.count_if(F.col("kind") == k)
    s = r.groupBy("source_id").agg(F.countDistinct("step").alias("steps"), count("error").alias("errors"), count("warning").alias("warnings"), count("artifact").alias("artifacts"), count("cache").alias("caches"), count("retry").alias("retries"), F.min_by("msg", F.when(F.col("kind") == "error", F.col("line_no"))).alias("first_error"))
    s = s.withColumn("status", F.when(F.col("errors") > 0, "failed").otherwise("success"))
    steps = r.groupBy("source_id", "step").agg(F.count(F.lit(1)).alias("lines"), count("error").alias("errors"), count("warning").alias("warnings"), F.min("line_no").alias("first_line"))
    signal = steps.withColumn("signal", (F.col("errors") > 0) | (F.col("warnings") > 0))
    any_ = signal.groupBy("source_id").agg(F.max("signal").alias("any"))
    w = Window.partitionBy("source_id").orderBy("first_line")
    shown = signal.join(any_, "source_id").where("signal or not any").withColumn("_r", F.row_number().over(w)).where("_r <= 6").select("source_id", "step", "lines", "errors", "warnings")
    return s, shown


def stacks(lines: DataFrame, head: str, frame: str) -> DataFrame:
    """PLG-18/19: (source_id, block, line_start, n_frames, exception, digest, copy): stack traces with the number of their copy (1 for the first)."""
    b = engine.blocks(lines, head).where("block > 0")
    inside = b.where(F.col("line").rlike(head) | F.col("line").rlike(frame))
    s = inside.groupBy("source_id", "block").agg(
        F.min("line_no").alias("line_start"), F.count_if(F.col("line").rlike(frame)).alias("n_frames"), F.min_by("line", "line_no").alias("exception"),
        F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.trim("line").alias("l")))), lambda x: x["l"]), "\n")).alias("digest"))
    # copies are numbered within a source, and a source hands on its count
    counts = s.groupBy("digest", "source_id").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("digest").orderBy("source_id").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("digest", "source_id", F.coalesce(before, F.lit(0)).alias("_start"))
    own = s.withColumn("_r", F.row_number().over(Window.partitionBy("digest", "source_id").orderBy("block")))
    return own.join(starts, ["digest", "source_id"]).withColumn("copy", (F.col("_start") + F.col("_r")).cast("int")).select(*s.columns, "copy")


def truncate_frames(lines: DataFrame, head: str, frame: str, most: int = 20) -> DataFrame:
    """PLG-18: of each trace the first ``most`` frames."""
    b = engine.blocks(lines, head).withColumn("_f", F.col("line").rlike(frame).cast("int"))
    n = scan.running_sum(b, F.col("_f"), "_n", ["source_id", "block"])
    return n.where((F.col("_f") == 0) | (F.col("_n") <= most)).select("source_id", "line_no", "line")


def exception_counts(records: DataFrame, least: int = 2) -> DataFrame:
    """PLG-18/19/23: kinds of exceptions or error codes that occur ``least`` times or more."""
    return records.where(F.col("key") != "").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def fold_warnings(lines: DataFrame, fmt, most: int = 3) -> DataFrame:
    """PLG-24: warnings of one kind after the third go; their count is reported by the kind."""
    r = engine.parse(lines, fmt).where("kind = 'diagnostic' and level = 'warning'").withColumn("sig", F.when(F.col("key") == "", F.regexp_replace("msg", "['‘][^'’]*['’]", "'?'")).otherwise(F.col("key")))
    kept, more = engine.keep_first(r, ["sig"], most)
    return kept.groupBy("source_id", "sig").agg(F.count(F.lit(1)).alias("shown")).join(more, ["source_id", "sig"], "left").select("source_id", "sig", "shown", F.coalesce("more", F.lit(0)).alias("more"))


def maven_totals(lines: DataFrame, fmt) -> DataFrame:
    """PLG-25: test totals of each source."""
    r = engine.parse(lines, fmt)
    t = lambda c: F.coalesce(F.sum(F.when(F.col("kind") == "tests", F.col(c).try_cast("bigint"))), F.lit(0))
    return r.groupBy("source_id").agg(t("value").alias("run"), t("key").alias("failures"), t("msg").alias("errors"), t("ln").alias("skipped"), F.count_if((F.col("kind") == "javac") & (F.col("level") == "WARNING")).alias("warnings"), F.count_if((F.col("kind") == "javac") & (F.col("level") == "ERROR")).alias("javac_errors"))


def terraform_totals(lines: DataFrame, fmt) -> DataFrame:
    """PLG-36: actions as A, D, M, R and the plan's totals."""
    r = engine.parse(lines, fmt)
    a = {"created": "A", "destroyed": "D", "updated in-place": "M", "replaced": "R"}
    return r.groupBy("source_id").agg(
        *[F.count_if((F.col("kind") == "resource") & (F.col("level") == k)).alias("n_" + v.lower()) for k, v in a.items()], F.count_if(F.col("kind") == "unknown").alias("known_after_apply"),
        F.max(F.when(F.col("kind") == "plan", F.col("value").try_cast("bigint"))).alias("plan_add"), F.max(F.when(F.col("kind") == "plan", F.col("key").try_cast("bigint"))).alias("plan_change"), F.max(F.when(F.col("kind") == "plan", F.col("msg").try_cast("bigint"))).alias("plan_destroy"))


def ansible_tasks(lines: DataFrame, fmt) -> DataFrame:
    """PLG-40: hosts by task and status."""
    r = engine.parse(lines, fmt).where("kind = 'host'")
    return r.groupBy("source_id", F.col("context").alias("task"), F.col("level").alias("status")).agg(F.array_join(F.array_sort(F.collect_set("key")), ",").alias("hosts"), F.count(F.lit(1)).alias("n"))


def gradle_resources(lines: DataFrame, fmt, least: int = 5) -> DataFrame:
    """PLG-26: runs of removed resources of one package with more than ``least`` names."""
    r = engine.parse(lines, fmt).where("kind = 'resource'")
    g = r.groupBy("source_id", F.col("key").alias("package")).agg(F.count(F.lit(1)).alias("n"), F.min_by("msg", "line_no").alias("first"), F.max_by("msg", "line_no").alias("last"))
    return g.withColumn("text", F.when(F.col("n") > least, F.format_string("[%s, ..., %s] (total %d)", "first", "last", "n")))


def cloud_dedup(records: DataFrame) -> DataFrame:
    """PLG-02: one record for each (time, normalised message)."""
    return records.withColumn("_m", N.compact_spaces(F.lower("msg"))).groupBy("value", "_m").agg(F.min(F.struct("source_id", "line_no")).alias("f"), F.count(F.lit(1)).alias("n"), F.min("level").alias("level")).select("f.source_id", "f.line_no", "value", F.col("_m").alias("msg"), "level", "n")


def cloud_access(records: DataFrame) -> DataFrame:
    """PLG-02: access records by (source, method, path, status) with hits and the hits of each ip."""
    per = records.groupBy("source", "method", "path", "status", "ip").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("source", "method", "path", "status").agg(F.sum("n").alias("hits"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("ip", "n")))).alias("ips"))


def clean_text(lines: DataFrame) -> DataFrame:
    """PLG-11: ANSI codes, redraws, tabs and runs of blank lines go."""
    out = lines.withColumn("line", N.tidy_blanks(N.last_redraw(N.strip_ansi(F.col("line")))))
    return filters.collapse_blank(out)


def ansi_report(text: Column) -> Column:
    """PLG-13: the text without ANSI codes, and how many bytes went."""
    out = N.last_redraw(N.strip_ansi(text))
    gone = F.octet_length(text) - F.octet_length(out)
    return F.when(gone > 0, F.concat(out, F.format_string("\n[stripped: %d ANSI bytes]", gone))).otherwise(out)


def noise(lines: DataFrame) -> DataFrame:
    """PLG-12: long hex masked, runs of more than five noise lines folded."""
    return engine.fold_runs(reduce.hex_dictionary(lines)[0], filters.is_noise(F.col("line")), 5, "[%d noise lines]")


def javadoc(lines: DataFrame) -> DataFrame:
    """PLG-25: runs of more than three generated pages."""
    return engine.fold_runs(lines, F.col("line").rlike(r"Generating\s+.*\.html\.\.\."), 3, "[javadoc: %d pages]")


def assets(lines: DataFrame) -> DataFrame:
    """PLG-28: runs of more than five asset loads."""
    return engine.fold_runs(lines, F.lower("line").rlike(r"^\s*(loading|loaded|unloading|importing)\s"), 5, "[%d asset operations]")


def compiling(lines: DataFrame) -> DataFrame:
    """PLG-23: runs of ``Compiling`` lines."""
    return engine.fold_runs(lines, F.trim("line").startswith("Compiling "), 1, "Compiling %d crates")


def probes(lines: DataFrame) -> DataFrame:
    """PLG-27: runs of probe calls, even single ones."""
    return engine.fold_runs(lines, F.contains("line", F.lit("/dev/null")), 0, "$XC|PROBE|x%d")


def junit(texts: DataFrame) -> DataFrame:
    """PLG-34: (source_id, tests, failures, errors, skipped, failing): totals of a JUnit report."""
    attr = lambda n: F.expr(f"aggregate(transform(regexp_extract_all(text, '(?s)<testsuite [^>]*\\\\b{n}=\"([0-9]+)\"', 1), x -> cast(x as bigint)), 0L, (a, x) -> a + x)")
    failing = F.regexp_extract_all("text", F.lit(r'(?s)<testcase [^>]*\bname="([^"]*)"[^>/]*>\s*<(?:failure|error)\b'), F.lit(1))
    return texts.select("source_id", attr("tests").alias("tests"), attr("failures").alias("failures"), attr("errors").alias("errors"), attr("skipped").alias("skipped"), F.array_join(failing, ",").alias("failing"))


SARIF = "struct<runs:array<struct<tool:struct<driver:struct<name:string>>,results:array<struct<ruleId:string,level:string>>>>>"


def sarif(texts: DataFrame) -> DataFrame:
    """PLG-34: results of a SARIF report by tool, level and rule."""
    r = texts.select("source_id", F.explode(F.from_json("text", SARIF)["runs"]).alias("r")).select("source_id", F.col("r.tool.driver.name").alias("tool"), F.explode("r.results").alias("x"))
    return r.groupBy("source_id", "tool", F.coalesce("x.level", F.lit("warning")).alias("level"), F.col("x.ruleId").alias("rule")).agg(F.count(F.lit(1)).alias("n"))


def minify_json(text: Column) -> Column:
    """PLG-06: minified, if it does not grow."""
    return filters.prefer_smaller(text, F.coalesce(N.canonical_json(text), text))


@F.pandas_udf(T.StringType())
def compact_yaml(texts: pd.Series) -> pd.Series:
    """PLG-07: deep levels and long sequences are cut; what does not parse stays."""
    try:
        import yaml
    except ImportError:
        return texts

    def cut(x, depth=0):
        if depth > 6 and isinstance(x, dict | list):
            return "..."
        if isinstance(x, dict):
            return {k: cut(v, depth + 1) for k, v in x.items()}
        if isinstance(x, list):
            return [cut(v, depth + 1) for v in x[:10]] + ([f"... {len(x) - 10} more"] if len(x) > 10 else [])
        return x

    def one(t):
        try:
            return yaml.safe_dump(cut(yaml.safe_load(t)), sort_keys=False, allow_unicode=True)
        except yaml.YAMLError:
            return t

    return texts.map(lambda t: t if t is None else one(t))


def identifiers(lines: DataFrame) -> DataFrame:
    """PLG-15: identifiers above eight bytes that are neither keywords nor exceptions."""
    found = lines.select("source_id", "line_no", F.posexplode(F.regexp_extract_all("line", F.lit(r"[A-Za-z_][A-Za-z0-9_]{8,}"), F.lit(0))).alias("pos", "value"))
    return found.where(~F.col("value").isin("interface", "implements", "protected", "continue", "undefined", "namespace", "constexpr") & ~F.col("value").rlike("(Exception|Error)$"))


def diff_context(lines: DataFrame, n: int = 3) -> DataFrame:
    """PLG-43: changed lines and headers with n lines around; each run left out is one marker."""
    head = r"^(diff --git |@@ |--- |\+\+\+ )"
    ranked = scan.running_sum(lines, F.lit(1), "rank", ["source_id"])
    hot = ranked.where(F.col("line").rlike(r"^[+-]") | F.col("line").rlike(head)).select("source_id", F.explode(F.sequence(F.col("rank") - n, F.col("rank") + n)).alias("rank")).distinct().withColumn("near", F.lit(True))
    df = ranked.join(hot, ["source_id", "rank"], "left").withColumn("keep", F.col("near").isNotNull())
    runs = scan.running_sum(df, F.col("keep").cast("int"), "run", ["source_id"])
    gone = runs.where("not keep").groupBy("source_id", "run").agg(F.min("line_no").alias("line_no"), F.count(F.lit(1)).alias("k"))
    return runs.where("keep").select("source_id", "line_no", "line").unionByName(gone.select("source_id", "line_no", F.format_string("... %d context lines ...", "k").alias("line")))


def unwrap_container(line: Column) -> Column:
    """PLG-32: the message inside a container's JSON line."""
    return F.coalesce(F.get_json_object(line, "$.log"), F.get_json_object(line, "$.message"), F.get_json_object(line, "$.msg"), line)


def shell_clean(lines: DataFrame) -> DataFrame:
    """PLG-44: prompts, environment dumps and progress lines go."""
    c = N.strip_ansi(F.col("line"))
    c = F.regexp_replace(c, r"^(?:[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+:?\s*[~/A-Za-z0-9_.-]*\s*[%#$>]+|PS\s+[A-Z]:\\[^>]*>|[A-Z]:\\[^>]*>|\+)\s*", "")
    out = lines.withColumn("line", F.regexp_replace(c, " {2,}", " "))
    return out.where(~F.col("line").rlike(r"^[A-Za-z_][A-Za-z0-9_]*=") & ~F.col("line").rlike(r"^\s*[0-9]+\s+[0-9][0-9.KMGT]*\s+[0-9]+\s+[0-9][0-9.KMGT]*\s") & ~F.col("line").rlike(r"^(?:x|Extracting)\s"))


def method_args(line: Column) -> Column:
    """PLG-21: arguments of frames as ``(...)``."""
    return F.regexp_replace(line, r"^(\s*at [A-Za-z0-9_.<>]+)\([^)]+\)", "$1(...)")


def with_error_signal(raw: Column, compacted: Column) -> Column:
    return filters.keep_error_signal(raw, filters.prefer_smaller(raw, compacted))
