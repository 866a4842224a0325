"""Version control output (VCS-*): records (source_id, line_no, tool, kind, rec_type, status, path, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import filters, scan
from ..reduce import unique_prefixes

# What the tools print.
GIT_SECTIONS = (("Changes to be committed", "staged"), ("Changes not staged", "unstaged"), ("Untracked files", "untracked"), ("Ignored files", "ignored"), ("Unmerged paths", "unmerged"))
GIT_WORDS = {"modified": "M", "new file": "A", "deleted": "D", "renamed": "R", "copied": "C", "typechange": "T", "both modified": "UU", "added by us": "AU", "deleted by us": "DU", "added by them": "UA", "deleted by them": "UD", "both added": "AA", "both deleted": "DD"}
#: tool -> (detector, ((rec_type, pattern, status group or text, path group, value group), ...)).
TOOLS = {
    "svn": (r"(?m)^(Index: |r[0-9]+ \| |[ACDGMU!?~X ][ CM]? {6}[^ ]|Updated to revision|Committed revision)", (
        ("commit", r"^r([0-9]+) \| ([^|]+) \| ([0-9-]+ [0-9:]+)", None, None, 1), ("rev", r"^(?:Updated to|Committed|At) revision ([0-9]+)", None, None, 1), ("diff_file", r"^Index: (.+)$", None, 1, None), ("file", r"^([ACDGMRUIE!?~X])[ CM]* +([^ ].*)$", 1, 2, None))),
    "hg": (r"(?m)^changeset: +[0-9]+:[0-9a-f]+", (("commit", r"^changeset: +[0-9]+:([0-9a-f]+)", None, None, 1), ("author", r"^user: +(.*)$", None, None, 1), ("date", r"^date: +(.*)$", None, None, 1), ("subject", r"^summary: +(.*)$", None, None, 1), ("branch", r"^branch: +(.*)$", None, None, 1), ("file", r"^([MARC!?I]) (.+)$", 1, 2, None))),
    "p4": (r"(?m)^(Change [0-9]+ (on|by)|//[^ ]+#[0-9]+|\.\.\. )", (("commit", r"^Change ([0-9]+) (?:on|by) (.*)$", None, None, 1), ("file", r"^(?:\.\.\. )?(//[^#]+)#([0-9]+) - ?([a-z/]+)?", 3, 1, 2), ("file", r"^\.\.\. (//[^#]+)#([0-9]+) ([a-z/]+)", 3, 1, 2))),
    "cvs": (r"(?m)^(RCS file: |cvs (update|status|diff)|File: .* Status: )", (("file", r"^File: ([^ ]+) *\tStatus: (.*)$", 2, 1, None), ("file", r"^([UPARMC?]) (.+)$", 1, 2, None), ("commit", r"^revision ([0-9.]+)", None, None, 1), ("diff_file", r"^RCS file: (.+)$", None, 1, None))),
    "bzr": (r"(?m)^(revno: [0-9]+|committer: |(modified|added|removed|unknown|renamed):$)", (("commit", r"^revno: ([0-9.]+)", None, None, 1), ("author", r"^committer: (.*)$", None, None, 1), ("section", r"^(modified|added|removed|unknown|renamed|conflicts):$", None, None, 1), ("file", r"^  (.+)$", None, 1, None))),
    "fossil": (r"(?m)^(checkout: +[0-9a-f]{10,}|(EDITED|ADDED|DELETED|MISSING|EXTRA|CONFLICT) +)", (("commit", r"^(?:checkout:|=+) +([0-9a-f]{10,})", None, None, 1), ("file", r"^(EDITED|ADDED|DELETED|MISSING|RENAMED|EXTRA|CONFLICT) +(.+)$", 1, 2, None), ("commit", r"^[0-9:]+ \[([0-9a-f]+)\] (.*)$", None, None, 1))),
    "darcs": (r"(?m)^(patch [0-9a-f]{40}|[MAR] \./)", (("commit", r"^patch ([0-9a-f]{40})", None, None, 1), ("author", r"^Author: (.*)$", None, None, 1), ("date", r"^Date: +(.*)$", None, None, 1), ("subject", r"^  \* (.*)$", None, None, 1), ("file", r"^([MAR]!?) (\./[^ ]+)", 1, 2, None))),
    "gh": (r"(?m)^(Showing [0-9]+ of [0-9]+|#[0-9]+\t)", (("item", r"^#?([0-9]+)\t([^\t]*)\t?(.*)$", None, None, 1), ("summary", r"^Showing ([0-9]+) of ([0-9]+)", None, None, 1))),
    "glab": (r"(?m)^(Showing [0-9]+ open|![0-9]+\t)", (("item", r"^[!#]([0-9]+)\t([^\t]*)", None, None, 1),)),
    "az": (r'"pullRequestId"|"repositoryId"', (("item", r'"pullRequestId": ([0-9]+)', None, None, 1), ("subject", r'"title": "([^"]*)"', None, None, 1), ("status", r'"status": "([^"]*)"', 1, None, None))),
    "bitbucket": (r"(?i)pull request #[0-9]+", (("item", r"(?i)pull request #([0-9]+)[: ]*(.*)$", None, None, 1),)),
    "gerrit": (r"(?m)^(change I[0-9a-f]{40}|Change-Id: I)", (("item", r"(?:change|Change-Id:) (I[0-9a-f]{40})", None, None, 1), ("subject", r"^ *subject: (.*)$", None, None, 1), ("status", r"^ *status: (.*)$", 1, None, None))),
    "repo": (r"(?m)^project [^ ]+/", (("project", r"^project ([^ ]+)/ +(?:branch (.*))?$", None, 1, 2), ("file", r"^ ([-A-Za-z]{2})\t(.+)$", 1, 2, None))),
}


def tool_of(text: Column) -> Column:
    """VCS-X3: git first, then the tools in the table's order."""
    out = F.when(text.rlike(r"(?m)^(On branch |diff --git |commit [0-9a-f]{40}|## )"), "git")
    for tool, (p, _) in TOOLS.items():
        out = out.when(text.rlike(p), tool)
    return out


def parse(lines: DataFrame, tool: str) -> DataFrame:
    """Records of any tool but git."""
    line = F.regexp_replace("line", r"\r$", "")
    pick = lambda p, g: F.lit(None).cast("string") if g is None else F.lit(g) if isinstance(g, str) else F.regexp_extract(line, p, g)
    rec = F.coalesce(*[F.when(line.rlike(p), F.struct(F.lit(t).alias("rec_type"), pick(p, s).alias("status"), pick(p, f).alias("path"), pick(p, v).alias("value"))) for t, p, s, f, v in TOOLS[tool][1]])
    return lines.withColumn("_r", rec).where("_r is not null").select("source_id", "line_no", F.lit(tool).alias("tool"), "_r.*")


def git_status(lines: DataFrame) -> DataFrame:
    """VCS-G1/G2: long and short form: (source_id, line_no, section, status, path)."""
    line = F.col("line")
    mark = F.lit(None).cast("string")
    for head, name in GIT_SECTIONS:
        mark = F.when(line.startswith(head), name).otherwise(mark)
    df = scan.forward_fill(lines, mark, "section", ["source_id"])
    word, path = F.regexp_extract(line, r"^\t(?:(modified|new file|deleted|renamed|copied|typechange|both modified|added by us|deleted by us|added by them|deleted by them|both added|both deleted): +)?(.+)$", 1), F.regexp_extract(line, r"^\t(?:(?:modified|new file|deleted|renamed|copied|typechange|both modified|added by us|deleted by us|added by them|deleted by them|both added|both deleted): +)?(.+)$", 1)
    code = F.lit(None).cast("string")
    for w, c in GIT_WORDS.items():
        code = F.when(word == w, c).otherwise(code)
    long = F.when(line.rlike(r"^\t[^ \t]"), F.struct(F.coalesce("section", F.lit("")).alias("section"), F.coalesce(code, F.when(F.col("section") == "untracked", "?").when(F.col("section") == "ignored", "I")).alias("status"), path.alias("path")))
    xy = F.substring(line, 1, 2)
    short = F.when(line.rlike(r"^[ MADRCUT?!]{2} [^ ]") & F.col("section").isNull(), F.struct(F.lit("short").alias("section"), F.when(xy.isin("??", "!!", "UU", "AU", "UA", "DU", "UD", "AA", "DD"), F.replace(F.replace(xy, F.lit("??"), F.lit("?")), F.lit("!!"), F.lit("I"))).when(F.substring(line, 1, 1) != " ", F.substring(line, 1, 1)).otherwise(F.substring(line, 2, 1)).alias("status"), F.substring(line, 4, 10_000).alias("path")))
    branch = F.when(line.rlike("^On branch |^## "), F.struct(F.lit("branch").alias("section"), F.lit("").alias("status"), F.regexp_extract(line, r"^(?:On branch |## )(.*)$", 1).alias("path")))
    return df.withColumn("_r", F.coalesce(branch, long, short)).where("_r is not null").select("source_id", "line_no", "_r.*")


def git_log(lines: DataFrame, least: int = 10) -> DataFrame:
    """VCS-G3: one row a commit: the shortest unique hash, the author's local part, date, subject, and whether it is a merge."""
    line = F.regexp_replace("line", r"^[*|/\\ ]+(?=(commit|Author:|Date:|Merge:|    ))", "")
    clean = lines.withColumn("line", line)
    b = scan.running_sum(clean, F.when(F.col("line").rlike("^commit [0-9a-f]{7,40}"), 1).otherwise(0), "block", ["source_id"]).where("block > 0")
    at = lambda p, g=1: F.min_by(F.regexp_extract("line", p, g), F.when(F.col("line").rlike(p), F.col("line_no")))
    c = b.groupBy("source_id", "block").agg(
        at("^commit ([0-9a-f]{7,40})").alias("hash"), at(r"^commit [0-9a-f]+ \(([^)]*)\)").alias("decoration"), at(r"^Author: .*?<?([A-Za-z0-9._+-]+)@").alias("author"), at(r"^(?:Date|AuthorDate): +(.*)$").alias("date"), at(r"^    (.*[^ ].*)$").alias("subject"), (F.count_if(F.col("line").startswith("Merge:")) > 0).alias("merge"))
    return c.join(unique_prefixes(c, "hash", least), "hash").select("source_id", "block", F.col("short").alias("hash"), "author", F.date_format(F.try_to_timestamp(F.regexp_replace("date", r"^[A-Za-z]{3} ", ""), F.lit("MMM d HH:mm:ss yyyy Z")), "yyyy-MM-dd HH:mm:ss").alias("date"), "decoration", "subject", "merge")


def git_diff(lines: DataFrame, most: int = 100) -> DataFrame:
    """VCS-G4: ``DIFF://path`` heads, no index and side lines, at most ``most`` lines a file and then a marker."""
    df = scan.forward_fill(lines, F.when(F.col("line").rlike("^diff --git "), F.regexp_extract("line", r"^diff --git a/.* b/(.*)$", 1)), "path", ["source_id"]).where("path is not null")
    df = df.where(~F.col("line").rlike(r"^(index |--- |\+\+\+ )"))
    head = F.col("line").rlike("^diff --git ")
    n = scan.running_sum(df, (~head).cast("int"), "_n", ["source_id", "path"])
    shown = n.where(F.col("_n") <= most).select("source_id", "line_no", "path", F.when(head, F.concat(F.lit("DIFF://"), "path")).otherwise(F.col("line")).alias("line"))
    return shown.unionByName(n.where(F.col("_n") == most + 1).select("source_id", "line_no", "path", F.lit("<TRUNCATED>").alias("line")))


def diff_stat(lines: DataFrame) -> DataFrame:
    """VCS-G4: (path, changes, plus, minus) of ``--stat`` rows."""
    p = r"^ (.+?) +\| +([0-9]+) ?(\+*)(-*)$"
    return lines.where(F.col("line").rlike(p)).select("source_id", "line_no", F.regexp_extract("line", p, 1).alias("path"), F.regexp_extract("line", p, 2).cast("bigint").alias("changes"), F.length(F.regexp_extract("line", p, 3)).alias("plus"), F.length(F.regexp_extract("line", p, 4)).alias("minus"))


def log_graph(lines: DataFrame, most: int = 10) -> DataFrame:
    """VCS-G5: graph lines without their drawing; the first ten, and the count if there are more."""
    c = lines.withColumn("line", F.trim(F.regexp_replace("line", r"^[*|/\\ ]+", ""))).where(F.size(F.split("line", " +")) >= 2)
    return _first(c, most)


def reflog(lines: DataFrame, most: int = 20) -> DataFrame:
    """VCS-G6."""
    return _first(lines.where(F.col("line").rlike(r"^[0-9a-f]{7,40} .*HEAD@\{")), most)


def _first(lines: DataFrame, most: int) -> DataFrame:
    n = scan.running_sum(lines, F.lit(1), "rank", ["source_id"])
    total = n.groupBy("source_id").agg(F.max("rank").alias("total"))
    return n.join(total, "source_id").where(F.col("rank") <= most).select("source_id", "rank", "total", "line")


def shorten_hashes(line: Column) -> Column:
    """VCS-G7."""
    return F.regexp_replace(line, "([0-9a-fA-F]{10})[0-9a-fA-F]{30}", "$1")


def svn_update(lines: DataFrame, least: int = 10) -> DataFrame:
    """VCS-S1: (source_id, n, revision, text); more than ten rows become one line."""
    r = parse(lines, "svn")
    g = r.groupBy("source_id").agg(F.count_if((F.col("rec_type") == "file") & F.col("status").isin("U", "A", "D")).alias("n"), F.max(F.when(F.col("rec_type") == "rev", F.col("value"))).alias("revision"))
    return g.withColumn("text", F.when(F.col("n") > least, F.format_string("[UPDATE] r%s: %d files updated", "revision", "n")))


def anchored(raw: Column, out: Column) -> Column:
    """VCS-X1: the first line that is not blank heads the output."""
    first = F.get(F.filter(F.split(raw, "\n"), lambda x: F.trim(x) != ""), F.lit(0))
    return F.when(out.startswith(first) | first.isNull(), out).otherwise(F.concat_ws("\n", first, out))


def compact_status(records: DataFrame) -> DataFrame:
    """Files by status, for any tool."""
    return records.where("status is not null and path is not null").groupBy("source_id", "status").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("path")), ",").alias("paths"))


def latest(records: DataFrame, key: str, n: int) -> DataFrame:
    return records.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("line_no")))).where(F.col("_r") <= n).drop("_r")


adjacent_unique = filters.adjacent_unique
