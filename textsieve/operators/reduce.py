"""Reduction: dictionaries, exact dedup to references, path factoring (RED-*)."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import normalize as N
from .store import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values.
MIN_BYTES = {"path": 10, "package": 5, "macro": 10, "command": 10}
PREFIX = {"path": "$P", "package": "$PK", "macro": "$M", "command": "$C"}
PATH = r"(?:[a-zA-Z]:\\|//|\./|\.\./|/|[A-Za-z0-9_.-]+/)[A-Za-z0-9_.\-+~=@#]+(?:[/\\][A-Za-z0-9_.\-+~=@#]+)*"
UNIX_PATH = r"/[A-Za-z0-9_./-]+"
BALANCED = {"conservative": (24, 3), "balanced": (16, 2), "aggressive": (10, 2)}


def first_seen(df: DataFrame, value: str, *position: str) -> DataFrame:
    """(value, n, first): each value's count and first position; partial sums before the shuffle, so that common values do not skew."""
    return df.groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*position)).alias("first"))


def ranked(df: DataFrame, order: Column | str, out: str = "id", parts: int | None = None) -> DataFrame:
    """Dense numbers from 0 by a unique order, without one task for all rows: range partitions are ranked one by one and shifted by the counts before them.

    The dealt rows are written once: the bounds of ranges are drawn from a sample, so that a second evaluation may deal otherwise."""
    spread = written(df.repartitionByRange(*([parts] if parts else []), order).withColumn("_part", F.spark_partition_id()), "ranked")
    counts = spread.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    start = counts.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    own = spread.withColumn("_r", F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1)
    return own.join(F.broadcast(start), "_part").withColumn(out, (F.col("_start") + F.col("_r")).cast("bigint")).drop("_part", "_r", "_start")


def dedup_lines(lines: DataFrame, least: int = 12, threshold: int = 2) -> tuple[DataFrame, DataFrame]:
    """RED-01/02: (tokens, dictionary). From the second occurrence on a line of ``least`` bytes (with its line break) or more is a reference.

    Ids follow the first appearance. The dictionary holds only lines that repeat; it is joined back, and Spark
    broadcasts it or splits the skewed side as its size demands."""
    long = F.octet_length("line") + 1 >= least
    seen = first_seen(lines.where(long), "line", "source_id", "line_no").where(F.col("n") >= threshold)
    dictionary = ranked(seen, F.col("first")).select(F.lit("macro").alias("dict_type"), F.concat(F.lit("$M"), F.col("id").cast("string")).alias("token"), F.col("line").alias("value"), "n", "first")
    joined = lines.join(dictionary.select(F.col("value").alias("line"), "token", "first"), "line", "left")
    is_ref = F.coalesce(F.struct("source_id", "line_no") != F.col("first"), F.lit(False))
    tokens = joined.select("source_id", F.col("line_no").alias("seq"), F.when(is_ref, "ref").otherwise("text").alias("kind"), F.when(is_ref, F.col("token")).otherwise(F.col("line")).alias("value"))
    return tokens, dictionary.withColumn("category", macro_category(F.col("value")))


def macro_category(value: Column) -> Column:
    """RED-06."""
    return F.when(F.lower(value).rlike("error|fail"), "Semantic").otherwise("Noise")


def dictionary_of(df: DataFrame, value: str, kind: str, *position: str) -> DataFrame:
    """RED-03/05/06/07: (dict_type, token, value) of values that are long enough and no tokens themselves."""
    own = df.where((F.octet_length(value) >= MIN_BYTES[kind]) & ~F.col(value).startswith("$"))
    out = ranked(first_seen(own, value, *position), F.col("first")).select(F.lit(kind).alias("dict_type"), F.concat(F.lit(PREFIX[kind]), F.col("id").cast("string")).alias("token"), F.col(value).alias("value"), "n")
    return out.withColumn("category", macro_category(F.col("value")) if kind == "macro" else F.lit("Structural"))


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)[/\\][^/\\]+$", 1)


def leaf(path: Column) -> Column:
    return F.regexp_extract(path, r"^.*[/\\]([^/\\]+)$", 1)


def layered(paths: DataFrame, path: str, *position: str) -> tuple[DataFrame, DataFrame]:
    """RED-04: paths as ``$Pn/leaf`` over a dictionary of directories; others stay."""
    own = paths.withColumn("_dir", directory(F.col(path)))
    dirs = dictionary_of(own.where("_dir <> ''"), "_dir", "path", *position)
    out = own.join(dirs.select(F.col("value").alias("_dir"), "token"), "_dir", "left")
    sep = F.when(F.contains(F.col(path), F.lit("/")), "/").otherwise("\\")
    return out.withColumn("layered", F.when(F.col("token").isNotNull(), F.concat("token", sep, leaf(F.col(path)))).otherwise(F.col(path))).drop("_dir", "token"), dirs


def hex_dictionary(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """NRM-14 with its dictionary: lines with long hex words as references or lengths, and the dictionary of the words."""
    found = lines.select("source_id", "line_no", F.posexplode(N.hex_words(F.col("line"))).alias("pos", "word")).where(F.length("word") <= N.HEX_DUMP)
    words = dictionary_of(found, "word", "path", "source_id", "line_no", "pos")
    own = found.join(words.select(F.col("value").alias("word"), "token"), "word").select("source_id", "line_no", "word", "token").distinct()
    maps = own.groupBy("source_id", "line_no").agg(F.map_from_entries(F.collect_list(F.struct("word", "token"))).alias("_m"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    out = lines.join(maps, ["source_id", "line_no"], "left")
    return out.withColumn("line", N.mask_hex(F.col("line"), F.coalesce("_m", none))).drop("_m"), words


def paths_in(lines: DataFrame, pattern: str = PATH) -> DataFrame:
    """RED-08/09: (source_id, line_no, pos, path) of what looks like a path; never in diff headers, after a scheme, or with ``@();=``."""
    from .filters import is_diff_header

    found = lines.where((F.contains("line", F.lit("/")) | F.contains("line", F.lit("\\"))) & ~is_diff_header(F.col("line")))
    found = found.withColumn("_l", F.regexp_replace("line", r"https?://[^ \"'<>]*", " "))
    return found.select("source_id", "line_no", F.posexplode(F.regexp_extract_all("_l", F.lit(pattern), F.lit(0))).alias("pos", "path")).where(~F.col("path").rlike(r"[@();=]") & ~F.col("path").rlike(r"^\.[A-Za-z0-9_]*$"))


def replace_paths(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """RED-08: lines with paths as dictionary references, and the dictionary. References of a line are put in longest first."""
    found = paths_in(lines)
    out, dirs = layered(found, "path", "source_id", "line_no", "pos")
    edits = out.where("layered <> path").groupBy("source_id", "line_no").agg(F.array_distinct(F.array_sort(F.collect_list(F.struct((-F.length("path")).alias("n"), "path", "layered")))).alias("edits"))
    done = lines.join(edits, ["source_id", "line_no"], "left").withColumn("line", F.when(F.col("edits").isNull(), F.col("line")).otherwise(F.aggregate("edits", F.col("line"), lambda acc, e: F.replace(acc, e["path"], e["layered"])))).drop("edits")
    return done, dirs


def prefixes(path: Column) -> Column:
    """/a/b/c -> [/a, /a/b, /a/b/c]."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, k), "/")))


def hierarchy(paths: DataFrame, path: str = "path") -> DataFrame:
    """RED-10: (prefix, n, children): how many distinct paths lie under a prefix, and in how many direct children."""
    nodes = paths.select(path).distinct().select(F.explode(prefixes(F.col(path))).alias("prefix"))
    counts = nodes.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))
    children = counts.where(F.length("prefix") > 1).select(F.regexp_extract("prefix", "^(.*)/[^/]*$", 1).alias("prefix")).groupBy("prefix").agg(F.count(F.lit(1)).alias("children"))
    return counts.join(children, "prefix", "left").select("prefix", "n", F.coalesce("children", F.lit(0)).alias("children"))


def common_prefixes(paths: DataFrame, path: str = "path", least: int = 20, uses: int = 2, top: int = 100) -> DataFrame:
    """RED-10/12: the longest prefixes that several paths share."""
    return hierarchy(paths, path).where((F.length("prefix") > least) & (F.col("n") >= uses)).orderBy(F.desc(F.length("prefix")), "prefix").limit(top)


def directories(paths: DataFrame, path: str = "path", busy: int = 10, gap: int = 15) -> DataFrame:
    """RED-11: (token, value): anchors of the path tree, numbered depth first.

    A node is an anchor if more than one of its children has more than ``busy`` paths (or it is a leaf with more than
    ``busy``), and more than ``gap`` characters lie between it and the anchor above. The tree has one row a prefix of
    the *distinct* paths that at least ``busy`` of them share, and is walked level by level."""
    tree = hierarchy(paths, path).withColumn("parent", F.regexp_extract("prefix", "^(.*)/[^/]*$", 1))
    heavy = tree.where(f"n > {busy}")
    busy_children = heavy.groupBy(F.col("parent").alias("prefix")).agg(F.count(F.lit(1)).alias("busy"))
    nodes = heavy.join(busy_children, "prefix", "left").select("prefix", "parent", ((F.coalesce("busy", F.lit(0)) > 1) | (F.col("children") == 0)).alias("ok"), (F.size(F.split("prefix", "/")) - 1).alias("level")).persist()
    levels = nodes.agg(F.max("level")).first()[0] or 0
    state, anchors = None, None
    for k in range(1, levels + 1):
        here = nodes.where(F.col("level") == k)
        here = here.withColumn("above", F.lit(0)) if state is None else here.join(state.select(F.col("prefix").alias("parent"), F.col("at").alias("above")), "parent", "left").withColumn("above", F.coalesce("above", F.lit(0)))
        here = here.withColumn("anchor", F.col("ok") & (F.length("prefix") - F.col("above") > gap)).withColumn("at", F.when(F.col("anchor"), F.length("prefix")).otherwise(F.col("above")))
        state = here
        anchors = here.where("anchor").select("prefix") if anchors is None else anchors.union(here.where("anchor").select("prefix"))
    if anchors is None:
        return nodes.select(F.lit("").alias("token"), F.col("prefix").alias("value")).limit(0)
    return ranked(anchors, F.col("prefix")).select(F.concat(F.lit("$D"), F.col("id").cast("string")).alias("token"), F.col("prefix").alias("value"))


def longest_prefix(paths: DataFrame, dirs: DataFrame, path: str = "path") -> DataFrame:
    """RED-11: paths rewritten with the longest ``$D`` that is a prefix: one join on exploded prefixes."""
    hit = paths.select(path).distinct().select(path, F.explode(prefixes(F.col(path))).alias("value")).join(dirs, "value").groupBy(path).agg(F.max_by("token", F.length("value")).alias("token"), F.max(F.length("value")).alias("n"))
    return paths.join(hit, path, "left").withColumn("short", F.when(F.col("token").isNull(), F.col(path)).otherwise(F.concat("token", F.substring(F.col(path), F.col("n") + 1, F.length(path))))).drop("token", "n")


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("footer", T.StringType())]))
def inline_paths(texts: pd.Series) -> pd.DataFrame:
    """RED-13: a document's own path dictionary by greedy set cover: the candidate that saves most is taken while it saves anything."""
    import itertools
    import re
    from collections import Counter

    def one(text: str | None) -> tuple[str, str]:
        text = text or ""
        uses = Counter(p.rsplit("/", 1)[0] for p in re.findall(r"/[A-Za-z0-9_./-]+", text) if "/" in p[1:])
        for prefix in list(uses):
            while "/" in prefix[1:]:
                prefix = prefix.rsplit("/", 1)[0]
                uses[prefix] += 0
        entries = []
        for n in itertools.count(1):
            best, gain = "", 0
            for c in uses:
                k = len(re.findall(re.escape(c) + r"(?=/)", text))
                g = k * (len(c) - len(f"$P{n}")) - (len(c) + 6)
                if k > 1 and (g, c) > (gain, best):
                    best, gain = c, g
            if not best:
                break
            text = re.sub(re.escape(best) + r"(?=/)", f"$P{n}", text)
            entries.append(f"$P{n}={best}")
        return text, ("paths: " + "; ".join(entries)) if entries else ""

    return pd.DataFrame([one(t) for t in texts], columns=["text", "footer"])


def merge_dictionaries(frames: list[DataFrame]) -> DataFrame:
    """RED-14: one dictionary of several: equal values share the token with the smallest number."""
    all_ = frames[0]
    for f in frames[1:]:
        all_ = all_.unionByName(f)
    return all_.groupBy("dict_type", "value").agg(F.sum("n").alias("n"), F.min(F.struct(F.length("token").alias("k"), F.col("token").alias("token"))).alias("t")).select("dict_type", "t.token", "value", "n")


def fuse(tokens: DataFrame) -> DataFrame:
    """RED-15: neighbouring text tokens become one."""
    from . import scan

    df = scan.running_sum(tokens, F.when(F.col("kind") == "ref", 1).otherwise(0), "_refs", ["source_id"], "seq")
    key = F.when(F.col("kind") == "ref", F.col("seq")).otherwise(F.lit(-1))
    return df.withColumn("_own", key).groupBy("source_id", "_refs", "kind", "_own").agg(F.min("seq").alias("seq"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"]), "\n").alias("value")).select("source_id", "seq", "kind", "value")


def token_bytes(kind: Column, value: Column) -> Column:
    """RED-16."""
    return F.octet_length(value)


def token_estimate(kind: Column, value: Column) -> Column:
    return F.when(kind == "ref", 1).when(kind == "marker", 2).when(kind == "diff", 5).otherwise(F.floor(F.octet_length(value) / 4)).cast("bigint")


def summary(lines: DataFrame, sources: DataFrame, tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Lines, references, bytes and token estimates before and after, by group (source_id, grp)."""
    out = tokens.join(sources, "source_id").groupBy("grp").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("kind") == "ref").alias("n_refs"), F.sum(F.octet_length("value") + 1).alias("bytes_out"), F.sum(token_estimate(F.col("kind"), F.col("value"))).alias("tokens_out"))
    raw = lines.join(sources, "source_id").groupBy("grp").agg(F.sum(F.octet_length("line") + 1).alias("bytes_in"))
    return raw.join(out, "grp").select("grp", "n_lines", "n_refs", "bytes_in", "bytes_out", "tokens_out", F.round(F.col("bytes_out") / F.col("bytes_in"), 6).alias("ratio"))


def skeleton_path(path: Column) -> Column:
    """RED-18."""
    p = F.filter(F.split(path, r"[/\\]"), lambda x: x != "")
    return F.when(F.size(p) > 2, F.concat(F.get(p, F.lit(0)), F.lit("/.../"), F.element_at(p, -1))).otherwise(path)


def shorten_paths(line: Column) -> Column:
    """RED-19: absolute paths above 40 bytes with more than three parts keep their last three."""
    return F.regexp_replace(line, r"(?<![A-Za-z0-9_./-])(?=/[A-Za-z0-9_./-]{40})/(?:[A-Za-z0-9_.-]+/)+((?:[A-Za-z0-9_.-]+/){2}[A-Za-z0-9_.-]+)", ".../$1")


def unique_prefixes(df: DataFrame, value: str = "hash", least: int = 7) -> DataFrame:
    """RED-21: the shortest prefix that no other value has, from the neighbours in sorted order.

    Values are compared within their first two characters' bucket, so that no task holds all of them."""
    own = df.select(value).distinct().withColumn("_b", F.substring(value, 1, 2))
    w = Window.partitionBy("_b").orderBy(value)
    near = own.withColumns({"_p": F.lag(value).over(w), "_n": F.lead(value).over(w)})
    shared = lambda a, b: F.coalesce(F.aggregate(F.sequence(F.lit(1), F.length(a)), F.lit(0), lambda acc, i: F.when((acc == i - 1) & (F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)), i).otherwise(acc)), F.lit(0))
    k = F.greatest(F.when(F.col("_p").isNull(), 0).otherwise(shared(F.col(value), F.col("_p"))), F.when(F.col("_n").isNull(), 0).otherwise(shared(F.col(value), F.col("_n")))) + 1
    return near.select(value, F.substring(F.col(value), F.lit(1), F.greatest(k, F.lit(least))).alias("short"))


def render_tree(paths: list[str], ascii_only: bool = False) -> str:
    """RED-20: a file list as a tree; directories with one child are joined."""
    root: dict = {}
    for p in sorted(set(paths)):
        node = root
        for part in [x for x in p.split("/") if x]:
            node = node.setdefault(part, {})
    tee, end, bar = ("|- ", "`- ", "|  ") if ascii_only else ("├─ ", "└─ ", "│  ")
    out: list[str] = []

    def walk(node: dict, indent: str) -> None:
        items = sorted(node.items(), key=lambda kv: (not kv[1], kv[0]))
        for i, (name, sub) in enumerate(items):
            while len(sub) == 1 and next(iter(sub.values())):
                (k, sub), = sub.items()
                name += "/" + k
            last = i == len(items) - 1
            out.append(indent + (end if last else tee) + name + ("/" if sub else ""))
            walk(sub, indent + ("   " if last else bar))

    walk(root, "")
    return "\n".join(out)


def trees(df: DataFrame, source: str, path: str, least: int = 4) -> DataFrame:
    """RED-20 for each source that lists ``least`` files or more in a shared directory."""
    @F.pandas_udf(T.StringType())
    def draw(files: pd.Series) -> pd.Series:
        return files.map(lambda f: render_tree(list(f)))

    return df.groupBy(source).agg(F.array_sort(F.collect_set(path)).alias("files")).where(F.size("files") >= least).select(source, F.size("files").alias("n_files"), draw("files").alias("tree"))
