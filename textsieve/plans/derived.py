"""Queries over texts that are made from the sample tables, by the same rule in Spark and DuckDB."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..operators import classify, inverse, reduce, reorder, rules, slicing, web
from ..operators.formats import engine, special, vcs
from ..operators.store import written
from ..sources import ingest, sinks
from .views import ACCESS, LOG, access_view, log_view

QUERIES: dict[str, tuple] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.table(spark, sf, "documents")


def event_lines(spark: SparkSession, sf: str, line: str) -> DataFrame:
    """(source_id, line_no, line): one line an event, by a SQL expression that both engines read alike."""
    return ingest.table(spark, sf, "events").select((F.col("user_id") % 10).alias("source_id"), F.col("event_id").alias("line_no"), F.expr(line).alias("line"))


def event_sql(line: str) -> str:
    return f"v as (select user_id % 10 as source_id, event_id as line_no, {line} as line from events)"


# ---- dictionaries --------------------------------------------------------------------------------

@query("package_dictionary", """with v as (select doc_id, 'org.' || source || '.' || lang as value from documents), f as (select value, count(*) as n, min(doc_id) as first from v where strlen(value) >= 5 group by value)
select '$PK' || (row_number() over (order by first) - 1) as token, value, n from f""")
def _packages(spark, sf):
    own = docs(spark, sf).select("doc_id", F.concat(F.lit("org."), "source", F.lit("."), "lang").alias("value"))
    return reduce.dictionary_of(own, "value", "package", "doc_id").select("token", "value", "n")


_COMPILE = "'/usr/bin/gcc -c -O2 -DMOD=' || cast(user_id % 7 as string) || ' src/' || event_type || '.c -c x -o out/' || event_type || '.o'"


@query("special_content", f"""with {event_sql(_COMPILE)}, m as (select source_id, line_no, regexp_extract_all(line, '{slicing.MACRO}') as m, regexp_extract_all(line, '{slicing.COMPILE}') as c from v)
select source_id, line_no, 'macro' as kind, unnest(m) as value from m union all select source_id, line_no, 'command', unnest(c) from m""")
def _special(spark, sf):
    return slicing.special_content(event_lines(spark, sf, _COMPILE)).select("source_id", "line_no", "kind", "value")


@query("command_dictionary", f"""with {event_sql(_COMPILE)}, c as (select source_id, line_no, unnest(regexp_extract_all(line, '{slicing.COMPILE}')) as value from v), f as (select value, count(*) as n, min((source_id, line_no)) as first from c where strlen(value) >= 10 group by value)
select '$C' || (row_number() over (order by first) - 1) as token, value, n from f""")
def _commands(spark, sf):
    found = slicing.special_content(event_lines(spark, sf, _COMPILE)).where("kind = 'command'")
    return reduce.dictionary_of(found, "value", "command", "source_id", "line_no").select("token", "value", "n")


TERMS = (("ERROR", "level"), ("WARNING", "level"), ("purchase", "event"), ("absent", "event"))


@query("known_terms", f"""with v as ({LOG}), w as (select distinct source_id, line_no, unnest(string_split_regex(line, '[ \\t\\n]+')) as term from v)
select distinct source_id, line_no, category from w join (values {", ".join(map(str, TERMS))}) t(term, category) using (term)""")
def _terms(spark, sf):
    known = spark.createDataFrame(TERMS, "term string, category string")
    return classify.known_terms(log_view(spark, sf), "line", known).select("source_id", "line_no", "category").distinct()


# ---- records -------------------------------------------------------------------------------------

_LOG_FORMAT = engine.Format("log_view", 0, lambda t: F.lit(0.0), (engine.Record("error", "ERROR (request [a-z]+)", {"msg": 1}), engine.Record("warning", "WARNING (slow [a-z]+)", {"msg": 1})))
_MARKED = f"v as ({LOG}), r as (select *, case when contains(line, 'ERROR request') then 'error' when contains(line, 'WARNING slow') then 'warning' end as kind from v), k as (select *, row_number() over (partition by source_id, kind order by line_no) as r from r where kind is not null)"


@query("record_signals", f"with {_MARKED} select source_id, line_no, kind from k where kind = 'error' and r <= 3")
def _signals(spark, sf):
    return engine.signals(engine.parse(log_view(spark, sf), _LOG_FORMAT), 3, "error").select("source_id", "line_no", "kind")


@query("record_folds", f"with {_MARKED}, g as (select source_id, kind, count(*) as n from k group by all) select source_id, kind, least(n, 3) as shown, greatest(n - 3, 0) as more from g")
def _folds(spark, sf):
    kept, more = engine.keep_first(engine.parse(log_view(spark, sf), _LOG_FORMAT), ["kind"], 3)
    shown = kept.groupBy("source_id", "kind").agg(F.count(F.lit(1)).alias("shown"))
    return shown.join(more, ["source_id", "kind"], "left").select("source_id", "kind", "shown", F.coalesce("more", F.lit(0)).alias("more"))


_TRACE = "case when event_type = 'error' then 'Exception in thread main E' || cast(user_id % 3 as string) when event_type = 'view' then '  at org.x.M' || cast(user_id % 2 as string) || '.run(M.java:1)' else 'other' end"


@query("stack_copies", f"""with {event_sql(_TRACE)}, b as (select *, count(*) filter (starts_with(line, 'Exception')) over (partition by source_id order by line_no) as block from v),
s as (select source_id, block, min(line_no) as line_start, count(*) filter (starts_with(line, '  at')) as n_frames, string_agg(trim(line), chr(10) order by line_no) as body from b where block > 0 and line <> 'other' group by all)
select source_id, block, line_start, n_frames, row_number() over (partition by body order by source_id, block) as copy from s""")
def _copies(spark, sf):
    return special.stacks(event_lines(spark, sf, _TRACE), "^Exception", "^  at ").select("source_id", "block", "line_start", "n_frames", "copy")


_SVN = "case event_type when 'view' then 'A' when 'click' then 'D' else 'U' end || '    mod' || cast(user_id % 7 as string) || '/f' || cast(event_id % 5 as string) || '.c'"


@query("vcs_status", f"""with {event_sql(_SVN)}, f as (select source_id, line[1:1] as status, substr(line, 6) as path from v), d as (select distinct * from f), n as (select source_id, status, count(*) as n from f group by all)
select source_id, status, n.n, string_agg(path, ',' order by path) as paths from d join n using (source_id, status) group by all""")
def _status(spark, sf):
    return vcs.compact_status(vcs.parse(event_lines(spark, sf, _SVN), "svn"))


@query("vcs_latest", f"with {event_sql(_SVN)} select source_id, line_no, substr(line, 6) as path from (select *, row_number() over (partition by source_id order by line_no desc) as r from v) where r <= 2")
def _latest(spark, sf):
    return vcs.latest(vcs.parse(event_lines(spark, sf, _SVN), "svn"), "source_id", 2).select("source_id", "line_no", "path")


@query("anchor_guard", """with a as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1] as first, case when doc_id % 2 = 0 then 'summary' else text end as out from documents)
select doc_id, md5(case when first is null or starts_with(out, first) then out else first || chr(10) || out end) as digest from a""")
def _anchor(spark, sf):
    out = F.when(F.col("doc_id") % 2 == 0, "summary").otherwise(F.col("text"))
    return docs(spark, sf).select("doc_id", F.md5(F.encode(vcs.anchored(F.col("text"), out), "UTF-8")).alias("digest"))


# ---- web -----------------------------------------------------------------------------------------

@query("cloud_access", f"""with a as ({ACCESS}), p as (select source, method, path, status, ip, count(*) as n from a group by all)
select source, method, path, status, cast(sum(n) as bigint) as hits, string_agg(ip || ':' || n, ',' order by ip) as ips from p group by source, method, path, status""")
def _cloud_access(spark, sf):
    text = F.array_join(F.transform(F.map_entries("ips"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return special.cloud_access(access_view(spark, sf)).withColumn("ips", text)


@query("web_form", f"""with a as ({ACCESS}), f as (select line_no, path as raw, method || ' ' || ua as agg, ip || ' ' || status as per from a), b as (select line_no, raw, case when strlen(agg) <= strlen(per) then agg else per end as best from f)
select line_no, case when strlen(best) < strlen(raw) then best else raw end as text from b""")
def _form(spark, sf):
    return access_view(spark, sf).select("line_no", web.choose_form(F.col("path"), F.concat_ws(" ", "method", "ua"), F.concat_ws(" ", "ip", "status")).alias("text"))


_ACCESS_LINE = """ip || ' - - [' || time || ']' || ' "' || method || ' ' || path || ' HTTP/1.1" ' || status || ' ' || bytes || ' "' || referer || '" "' || ua || '"'"""
_WRAPPED = f"""case line_no % 3 when 0 then {_ACCESS_LINE} when 1 then replace(time, ' ', 'T') || '.123Z app/web/0123456789abcdef ' || {_ACCESS_LINE} else '| ' || replace(time, ' ', 'T') || 'Z | ' || {_ACCESS_LINE} || ' |' end"""


@query("web_wrapped", f"""with a as ({ACCESS}) select line_no, case line_no % 3 when 0 then 'combined' when 1 then 'AWS:app/web/01234567' else 'CLOUD_TABLE' end as source, time, ip, method, path, status, bytes, referer, ua
from a where regexp_matches(path, '^[^ \\t\\r\\n]+$')""")
def _wrapped(spark, sf):
    rows = access_view(spark, sf).select(F.lit(0).alias("source_id"), "line_no", F.expr(_WRAPPED).alias("line"))
    return web.parse(rows).select("line_no", "source", "time", "ip", "method", "path", "status", "bytes", "referer", "ua")


def _server_line(spark: bool) -> str:
    st, time = ("string", "date_format(ts, 'yyyy/MM/dd HH:mm:ss')") if spark else ("varchar", "strftime(ts, '%Y/%m/%d %H:%M:%S')")
    return f"case when event_type = 'error' then {time} || ' [error] 31#0: *' || cast(event_id as {st}) || ' upstream timed out for user ' || cast(user_id as {st}) else 'GET ' || event_type end"


@query("web_error_lines", f"with {event_sql(_server_line(False))} select source_id, line_no, line[1:19] as time, 'error' as level, '31' as pid, '$W|E|' || line[1:19] || '|error|upstream timed out for user ' || regexp_extract(line, '([0-9]+)$', 1) as text from v where not starts_with(line, 'GET')")
def _server_errors(spark, sf):
    return web.errors(event_lines(spark, sf, _server_line(True))).drop("msg")


# ---- lines and texts -----------------------------------------------------------------------------

_TASK = "'[task' || cast(user_id % 5 as string) || '] at 0x00ff' || cast(100000 + event_id % 900000 as string) || ' done'"


@query("log_reorder", f"with {event_sql(_TASK)} select source_id, line_no, regexp_replace(line, '0x[0-9a-f]+', '0x[ADDR]') as line, row_number() over (partition by source_id order by line[1:7], line_no) as place from v")
def _log_reorder(spark, sf):
    return reorder.log_reorder(event_lines(spark, sf, _TASK)).select("source_id", "line_no", "line", "place")


@query("split_records", "select doc_id, len(list_filter(string_split_regex(text, 'e +'), lambda x: trim(x) <> '')) as n from documents")
def _split(spark, sf):
    return docs(spark, sf).select("doc_id", F.size(rules.split_records(F.col("text"), "e +")).cast("bigint").alias("n"))


@query("verify_fixtures", "select doc_id as file from documents where doc_id % 10 = 0 and text is not null")
def _verify(spark, sf):
    """The expected texts have other line ends, and every tenth another end."""
    actual = docs(spark, sf).select(F.col("doc_id").alias("file"), "text")
    expected = actual.withColumn("text", F.concat(F.replace("text", F.lit("\n"), F.lit(" \r\n")), F.when(F.col("file") % 10 == 0, "x").otherwise("")))
    return rules.verify(actual, expected)


@query("config_format", f"with v as ({LOG}), c as (select source_id, line_no, regexp_replace(line, '[0-9]+', 'N', 'g') as line from v), p as (select *, lag(line) over (partition by source_id order by line_no) as before from c) select source_id, line_no, line from p where before is null or before <> line")
def _config(spark, sf):
    _, compress = rules.config_format({"detect": ["user="], "compress": [["[0-9]+", "N"]], "dedup": True})
    return compress(log_view(spark, sf))


@query("top_per_key", f"with a as ({ACCESS}) select ip, line_no, duration_ms from (select *, row_number() over (partition by ip order by duration_ms desc, line_no) as r from a) where r <= 2")
def _top(spark, sf):
    return classify.top_per_key(access_view(spark, sf), "ip", 2, F.desc("duration_ms"), F.col("line_no")).select("ip", "line_no", "duration_ms")


@query("paragraph_caps", """with recursive l as (select doc_id % 10 as source_id, doc_id as line_no, strlen(coalesce(lang, '') || source) as b, coalesce(lang, '') || source as line from documents),
r as (select *, row_number() over (partition by source_id order by line_no) as k from l),
g as (select source_id, line_no, k, b as size, 1 as n, 0 as cut from r where k = 1
 union all select r.source_id, r.line_no, r.k, case when g.n >= 7 or g.size >= 60 then r.b else g.size + 1 + r.b end, case when g.n >= 7 or g.size >= 60 then 1 else g.n + 1 end, case when g.n >= 7 or g.size >= 60 then g.cut + 1 else g.cut end
 from g join r on r.source_id = g.source_id and r.k = g.k + 1)
select source_id, min(line_no) as line_start, max(line_no) as line_end, count(*) as n_lines from g group by source_id, cut""")
def _caps(spark, sf):
    own = docs(spark, sf).select((F.col("doc_id") % 10).alias("source_id"), F.col("doc_id").alias("line_no"), F.concat(F.coalesce("lang", F.lit("")), "source").alias("line"))
    return slicing.paragraphs(own, max_lines=7, max_bytes=60).select("source_id", "line_start", "line_end", "n_lines")


@query("trim_bytes", "select doc_id, case when strlen(text) > 50 then left(text, list_max(list_filter(range(0, 51), lambda k: strlen(left(text, cast(k as bigint))) <= 50))) || '...' else text end as head from documents")
def _trim(spark, sf):
    return docs(spark, sf).select("doc_id", N.trim_to(F.col("text"), 50).alias("head"))


@query("number_forms", """with n as (select o_orderkey, cast(floor(o_totalprice * (1 + o_orderkey % 7) * (case when o_orderkey % 3 = 0 then 1000 when o_orderkey % 3 = 1 then 1 else 0.001 end)) as bigint) as n from orders)
select o_orderkey, format('{:,}', n) as thousands, case when n < 1024 then n || ' B' when n < 1048576 then printf('%.2f KB', n / 1024.0) when n < 1073741824 then printf('%.2f MB', n / 1048576.0) else printf('%.2f GB', n / 1073741824.0) end as bytes from n""")
def _numbers(spark, sf):
    factor = F.when(F.col("o_orderkey") % 3 == 0, 1000).when(F.col("o_orderkey") % 3 == 1, 1).otherwise(0.001)
    n = F.floor(F.col("o_totalprice") * (1 + F.col("o_orderkey") % 7) * factor).cast("bigint")
    return ingest.table(spark, sf, "orders").select("o_orderkey", N.thousands(n).alias("thousands"), N.human_bytes(n).alias("bytes"))


@query("restore_marks", "select conv_id, turn, md5(case when turn % 2 = 0 then 'Note: [T+Xms] are relative to Base Timestamp 2026-01-0' || (1 + turn % 9) || chr(10) || chr(10) else '' end || '[Pipeline] ' || text) as digest from conversations")
def _marks(spark, sf):
    base = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("2026-01-0"), (1 + F.col("turn") % 9).cast("string")))
    text = inverse.restore_marks(F.concat(F.lit("$PL "), "text"), base)
    return ingest.table(spark, sf, "conversations").select("conv_id", "turn", F.md5(F.encode(text, "UTF-8")).alias("digest"))


# ---- sinks ---------------------------------------------------------------------------------------

def _place(spark: SparkSession, tag: str) -> str:
    """A new folder beside those that operators write."""
    return f"{written(spark.range(1), tag).inputFiles()[0].rpartition('/')[0]}-{uuid.uuid4().hex}"


@query("usage_sink", "select cast(cast(ts as date) as varchar) as day, count(*) as n from events group by 1")
def _sink(spark, sf):
    """Usage rows as they are appended, read back by their days."""
    path = _place(spark, "usage")
    sinks.record(ingest.table(spark, sf, "events").select(F.col("ts").alias("timestamp"), "event_id"), path)
    return spark.read.parquet(path).groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("raw_tee", f"with v as ({LOG}) select source_id, count(*) as n, cast(sum(strlen(line)) as bigint) as bytes from v group by source_id")
def _tee(spark, sf):
    kept = sinks.tee(log_view(spark, sf), _place(spark, "raw"))
    return kept.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("line")).alias("bytes"))
