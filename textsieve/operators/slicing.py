"""Segmentation (SLC-*): slices of lines.

A slice has (source_id, slice_no, slice_type, line_start, line_end, text)."""

from __future__ import annotations

import sys
from functools import partial

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan
from .filters import contains_any, quote

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values.
ENTITIES = ("&nbsp;", "&lt;", "&gt;", "&amp;", "&quot;", "&apos;", "&copy;", "&reg;", "&trade;", "&mdash;", "&ndash;", "&lsquo;", "&rsquo;", "&ldquo;", "&rdquo;", "&hellip;", "&bull;", "&middot;", "&#")
XML_HINTS = ("#{", "${", "/>")
MAX_LINES, MAX_BYTES = 2000, 128 * 1024
MACRO = r"-[DIULfWom][A-Za-z0-9_.\-+=]+|-std=[A-Za-z0-9_]+|-O[0-9z]+|-Wall|-Wextra|-fPIC|-fomit-frame-pointer|-pipe"
COMPILE = r"^(?:\[[0-9\-:TZ]+\][ \t]*)?([A-Za-z0-9_\-./]+(?:gcc|g\+\+|clang|ld)(?:[ \t]*[A-Za-z0-9_\-./]+)*)[ \t]+.*?[ \t]+-c[ \t]+.*?[ \t]+-o[ \t]+([^ \t]+)"
STACK = r"(?:at|in)[ \t]+[A-Za-z0-9_:()\[\]<>]+"
HEADER = r"^\[[0-9]{4}-[0-9]{2}-[0-9]{2}T[A-Za-z0-9_:.]+Z\]"


def line_slices(lines: DataFrame) -> DataFrame:
    """SLC-01."""
    return lines.select("source_id", F.col("line_no").alias("slice_no"), F.lit("Line").alias("slice_type"), F.col("line_no").alias("line_start"), F.col("line_no").alias("line_end"), F.col("line").alias("text"))


def is_indented(line: Column) -> Column:
    """SLC-04."""
    return line.rlike(r"^[ \t]+[^ \t]")


def tag_type(text: Column) -> Column:
    """SLC-05: null where no tag rule holds."""
    t = F.trim(text)
    out = F.when(t.startswith("<!DOCTYPE") | t.startswith("<html"), "HtmlBlock").when(t.startswith("<?xml"), "XmlBlock").when(t.startswith("<svg"), "HtmlBlock")
    out = out.when(contains_any(t, XML_HINTS), "HtmlBlock")
    out = out.when(F.contains(F.substring_index(t, ":", 1), F.lit("<")) & F.contains(t, F.lit(":")), "HtmlBlock")
    out = out.when(framework_type(t).isNotNull(), framework_type(t))
    return out.when(contains_any(t, ENTITIES), "HtmlBlock").when(t.startswith("diff --git"), "GitDiffBlock")


def pattern(text: Column, kind: str, value: str, end: str | None = None) -> Column:
    """SLC-06: one feature: contains, starts_with, ends_with, prefix_char, paired_delimiters; anything else never holds."""
    return {
        "contains": lambda: F.contains(text, F.lit(value)),
        "starts_with": lambda: F.ltrim(text).startswith(value),
        "ends_with": lambda: F.rtrim(text).endswith(value),
        "prefix_char": lambda: text.rlike("(?s)^.*?" + quote(value) + "[A-Za-z]"),
        "paired_delimiters": lambda: F.contains(text, F.lit(value)) & (F.lit(True) if end is None else F.contains(text, F.lit(end))),
    }.get(kind, lambda: F.lit(False))()


def rule(text: Column, spec: dict) -> Column:
    """any / all / combo of features."""
    make = lambda ps: [pattern(text, *p) for p in ps]
    def fold(cs, op, empty):
        out = F.lit(empty)
        for i, c in enumerate(cs):
            out = c if not i else (out | c if op == "or" else out & c)
        return out

    if "any" in spec:
        return fold(make(spec["any"]), "or", False)
    if "all" in spec:
        return fold(make(spec["all"]), "and", True)
    return fold(make(spec.get("required", [])), "and", True) & (fold(make(spec["optional"]), "or", True) if spec.get("optional") else F.lit(True))


#: (slice type, priority, rules); the highest priority whose rules all hold wins.
FRAMEWORKS = (
    ("VueComponent", 100, ({"any": [("contains", "<template>"), ("contains", "v-if="), ("contains", "v-for="), ("contains", "v-bind:")]},)),
    ("SvelteComponent", 95, ({"any": [("contains", "{#if"), ("contains", "{#each"), ("contains", "on:click={")]},)),
    ("AngularComponent", 90, ({"any": [("contains", "*ngIf"), ("contains", "*ngFor"), ("contains", "[(ngModel)]")]},)),
    ("ReactComponent", 85, ({"any": [("contains", "className="), ("contains", "onClick={")]},)),
    ("ERBTemplate", 80, ({"any": [("paired_delimiters", "<%", "%>")]},)),
    ("FreemarkerTemplate", 75, ({"any": [("contains", "<#if"), ("contains", "<#list")]},)),
    ("HandlebarsTemplate", 70, ({"all": [("paired_delimiters", "{{", "}}")]},)),
)


def framework_type(text: Column, frameworks=FRAMEWORKS) -> Column:
    out = F.lit(None).cast("string")
    for kind, _, rules in sorted(frameworks, key=lambda f: f[1]):
        ok = rule(text, rules[0])
        for r in rules[1:]:
            ok = ok & rule(text, r)
        out = F.when(ok, kind).otherwise(out)
    return out


def flags(text: Column) -> Column:
    """SLC-07: what a slice holds."""
    return F.struct(
        F.contains(text, F.lit("/")).alias("has_paths"), text.rlike(MACRO).alias("has_macros"), text.rlike(COMPILE).alias("has_compile_commands"),
        text.rlike(STACK).alias("has_stack_trace"), text.rlike(HEADER).alias("has_log_headers"),
    )


def special_content(lines: DataFrame) -> DataFrame:
    """SLC-07: macros and compile commands for the dictionary: (source_id, line_no, pos, kind, value)."""
    found = F.concat(
        F.transform(F.regexp_extract_all("line", F.lit(MACRO), F.lit(0)), lambda x: F.struct(F.lit("macro").alias("kind"), x.alias("value"))),
        F.transform(F.regexp_extract_all("line", F.lit(COMPILE), F.lit(0)), lambda x: F.struct(F.lit("command").alias("kind"), x.alias("value"))),
    )
    return lines.where(F.contains("line", F.lit("-"))).select("source_id", "line_no", F.posexplode(found).alias("pos", "f")).select("source_id", "line_no", "pos", "f.kind", "f.value")


def _greedy(batches, max_lines: int, max_bytes: int):
    """Numbers the pieces of each run: a piece ends with the line that reaches a cap."""
    run, cut, n, size = None, 0, 0, 0
    for df in batches:
        cuts = []
        for source, island, b in zip(df["source_id"], df["island"], df["size"], strict=True):
            if (source, island) != run:
                run, cut, n, size = (source, island), 0, 0, 0
            size += b + (n > 0)
            n += 1
            cuts.append(cut)
            if n >= max_lines or size >= max_bytes:
                cut, n, size = cut + 1, 0, 0
        yield df.drop(columns="size").assign(cut=cuts)


def paragraphs(lines: DataFrame, max_lines: int = MAX_LINES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """SLC-02: runs of lines that are not blank, cut when they reach the caps (the line that crosses a cap still belongs).

    Only runs above the caps are cut, line by line: their lines' sizes are read as a sorted stream."""
    blank = F.trim("line") == ""
    df = scan.running_sum(lines, blank.cast("int"), "island", ["source_id"]).where(~blank)
    run = ["source_id", "island"]
    sizes = df.groupBy(*run).agg(F.count(F.lit(1)).alias("_n"), (F.sum(F.octet_length("line") + 1) - 1).alias("_b"))
    over = sizes.where((F.col("_n") > max_lines) | (F.col("_b") > max_bytes)).select(*run)
    long = df.join(over, run).select(*run, "line_no", F.octet_length("line").cast("bigint").alias("size"))
    # dealt by an expression of its own: a repartition by the columns of the join before it is left out, and the join may be broadcast
    cuts = long.repartition(F.xxhash64(*run)).sortWithinPartitions(*run, "line_no").mapInPandas(
        partial(_greedy, max_lines=max_lines, max_bytes=max_bytes), ", ".join(f"{n} {t}" for n, t in long.drop("size").dtypes) + ", cut bigint")
    df = df.join(cuts, [*run, "line_no"], "left").withColumn("_cut", F.coalesce("cut", F.lit(0)))
    return df.groupBy("source_id", "island", "_cut").agg(
        F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"), F.count(F.lit(1)).alias("n_lines"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"),
    ).select("source_id", F.col("line_start").alias("slice_no"), F.lit("Paragraph").alias("slice_type"), "line_start", "line_end", "n_lines", "text")


def hybrid(lines: DataFrame) -> DataFrame:
    """SLC-03: tagged lines, then indented ones, are slices of their own; the rest are paragraphs."""
    kind = F.coalesce(tag_type(F.col("line")), F.when(is_indented(F.col("line")), "CodeBlock"))
    df = lines.withColumn("_k", kind)
    own = df.where("_k is not null").select("source_id", F.col("line_no").alias("slice_no"), F.col("_k").alias("slice_type"), F.col("line_no").alias("line_start"), F.col("line_no").alias("line_end"), F.lit(1).cast("bigint").alias("n_lines"), F.col("line").alias("text"))
    rest = paragraphs(df.withColumn("line", F.when(F.col("_k").isNull(), F.col("line")).otherwise("")).drop("_k"))
    return own.unionByName(rest)


def newline_slices(lines: DataFrame) -> DataFrame:
    """SLC-08: the separators that paragraphs lose: one row for each run of blank lines, with its line breaks."""
    blank = F.trim("line") == ""
    df = scan.running_sum(lines, (~blank).cast("int"), "island", ["source_id"]).where(blank)
    return df.groupBy("source_id", "island").agg(F.min("line_no").alias("line_start"), F.count(F.lit(1)).alias("n")).select("source_id", "line_start", F.least(F.col("n"), F.lit(2)).alias("newlines"))
