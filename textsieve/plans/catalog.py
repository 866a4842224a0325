"""Queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..operators import classify, filters, inverse, reduce, reorder, slicing, templates, tracking, web
from ..sources import ingest
from ..streaming import stream
from . import derived, fixtures
from .views import ACCESS, LOG, access_view, log_view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

Query = Callable[[SparkSession, str], DataFrame]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.table(spark, sf, "documents")


def doc_lines(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.lines(docs(spark, sf), "doc_id")


# The lines of documents: one trailing empty element goes, and one carriage return a line.
LINES = """
l0 as (select doc_id as source_id, string_split(coalesce(text,''), chr(10)) as a from documents),
l1 as (select source_id, case when a[len(a)] = '' then a[1:len(a)-1] else a end as a from l0),
lines as (select source_id, unnest(generate_series(1, len(a))) as line_no, regexp_replace(unnest(a), '\\r$', '') as line from l1)"""
DEDUP = f"""{LINES},
r as (select *, row_number() over (partition by line order by source_id, line_no) as rn, count(*) over (partition by line) as n from lines),
dict as (select line, row_number() over (order by source_id, line_no) - 1 as id from r where rn = 1 and n >= 2 and strlen(line) + 1 >= 12),
tok as (select r.source_id, r.line_no, r.line, case when d.id is not null and rn > 1 then 'ref' else 'text' end as kind,
        case when d.id is not null and rn > 1 then '$M' || d.id else r.line end as value from r left join dict d on r.line = d.line)"""


# ---- ingestion -----------------------------------------------------------------------------------

@query("line_scan", f"with {LINES} select source_id, line_no, line from lines")
def _line_scan(spark, sf):
    return doc_lines(spark, sf)


@query("line_offsets", f"with {LINES} select source_id, line_no, cast(coalesce(sum(strlen(line) + 1) over (partition by source_id order by line_no rows between unbounded preceding and 1 preceding), 0) as bigint) as \"offset\", line from lines")
def _line_offsets(spark, sf):
    return ingest.lines_with_offsets(docs(spark, sf), "doc_id")


@query("block_scan", "select doc_id as source_id, cast(i as bigint) as block_no, substr(text, cast(i * 4096 + 1 as bigint), 4096) as block from documents, unnest(generate_series(0, (length(text) - 1) // 4096)) t(i) where length(text) > 0")
def _blocks(spark, sf):
    return ingest.blocks(docs(spark, sf), "doc_id", 4096)


@query("chunk_assign", f"""with {LINES},
s as (select *, coalesce(sum(strlen(line) + 1) over (partition by source_id order by line_no rows between unbounded preceding and 1 preceding), 0) as pos,
      trim(line) = '' or regexp_matches(line, '^[0-9\\[]') or not regexp_matches(line, '^[ \\t]') as anchor from lines),
f as (select *, last_value(case when anchor then pos end ignore nulls) over (partition by source_id order by line_no rows between unbounded preceding and current row) as h from s)
select source_id, line_no, line, cast(coalesce(h, 0) // 1024 as bigint) as chunk_no from f""")
def _chunks(spark, sf):
    return ingest.chunks(doc_lines(spark, sf), 1024)


@query("binary_sniff", "select doc_id, contains(left(text, 8192), chr(0)) as is_binary from documents")
def _binary(spark, sf):
    return docs(spark, sf).select("doc_id", ingest.is_binary(F.encode("text", "UTF-8")).alias("is_binary"))


@query("bom_sniff", "select k, b from (values (0,'utf-8'),(1,'utf-16le'),(2,'utf-16be'),(3,'utf-32le'),(4,'utf-32be'),(5,null)) t(k, b)")
def _bom(spark, sf):
    rows = [(0, bytearray(b"\xef\xbb\xbfa")), (1, bytearray(b"\xff\xfea\0")), (2, bytearray(b"\xfe\xff\0a")), (3, bytearray(b"\xff\xfe\0\0")), (4, bytearray(b"\0\0\xfe\xff")), (5, bytearray(b"abcd"))]
    return spark.createDataFrame(rows, "k int, d binary").select("k", ingest.bom(F.col("d")).alias("b"))


@query("mojibake_flags", f"select doc_id, (length(text) - length(replace(text, '�', '')) >= 2) or (len(regexp_extract_all(text, '{ingest.MARKERS}')) >= 2 and len(regexp_extract_all(text, '{ingest.MARKERS}')) / greatest(length(text), 1) >= 0.08) as mojibake from documents")
def _mojibake(spark, sf):
    return docs(spark, sf).select("doc_id", ingest.is_mojibake(F.col("text")).alias("mojibake"))


@query("decode_fallback", """select doc_id, case when doc_id % 2 = 0 or length(coalesce(text, '')) < 2 then 'utf-8' else 'utf-16-le' end as encoding,
case when text is null then 0 when doc_id % 2 = 1 and length(text) = 1 then 2 else length(text) end as n from documents""")
def _decode(spark, sf):
    own = docs(spark, sf).select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.encode("text", "UTF-16LE")).alias("data"))
    return own.withColumn("d", ingest.decode("data")).select("doc_id", "d.encoding", F.length("d.text").alias("n"))


# A control character is put before every word of some documents, and a NUL before every letter of others.
@query("probable_binary", """with t as (select doc_id, case doc_id % 5 when 0 then regexp_replace(text, '[a-z]', chr(1) || '\\0', 'g') when 1 then replace(text, ' ', ' ' || chr(2)) else text end as text from documents),
b as (select doc_id, string_split(rtrim(regexp_replace(hex(encode(text))[1:16384], '(..)', '\\1 ', 'g')), ' ') as b from t)
select doc_id, coalesce(b[1] <> '' and len(list_filter(b, lambda x: x < '20' and x not in ('00', '09', '0A', '0D'))) >= 0.22 * len(b), false) as binary from b""")
def _probable_binary(spark, sf):
    t = F.when(F.col("doc_id") % 5 == 0, F.regexp_replace("text", "([a-z])", "\u0001$1")).when(F.col("doc_id") % 5 == 1, F.replace("text", F.lit(" "), F.lit(" \u0002"))).otherwise(F.col("text"))
    return docs(spark, sf).select("doc_id", ingest.is_probable_binary(F.encode(t, "UTF-8")).alias("binary"))


# Read as ISO 8859-1, a character of one of these ranges leaves one marker behind, a replacement character one as well.
@query("mojibake_repair", f"""with m as (select doc_id, coalesce(text, '') as text, len(regexp_extract_all(text, '[\\x{{80}}-\\x{{FF}}\\x{{400}}-\\x{{47F}}\\x{{FFFD}}]')) as bad, len(regexp_extract_all(text, '{ingest.MARKERS}')) + 2 * len(regexp_extract_all(text, '\\x{{FFFD}}')) as good from documents),
g as (select *, coalesce(bad - good, 0) as gain from m)
select doc_id, cast(case when gain > 0 then length(text) else strlen(text) end as bigint) as n, case when gain >= 5 then 'high' when gain >= 2 then 'medium' else 'low' end as confidence from g""")
def _repair(spark, sf):
    own = docs(spark, sf).select("doc_id", F.decode(F.encode("text", "UTF-8"), "ISO-8859-1").alias("bad"))
    fixed = own.withColumn("text", ingest.repair("bad"))
    return fixed.select("doc_id", F.length("text").alias("n"), ingest.repair_confidence(F.col("bad"), F.col("text")).alias("confidence"))


@query("session_commands", "select conv_id as source_id, 1 as seq, 'git show ' || role as command, strlen(text) as output_bytes from conversations")
def _session(spark, sf):
    conv = ingest.table(spark, sf, "conversations").select("conv_id", "turn", F.to_json(F.array(F.struct(F.concat(F.lit("git show "), "role").alias("command"), F.octet_length("text").cast("bigint").alias("output_bytes")))).alias("text"))
    return ingest.session_commands(conv, "conv_id").select("source_id", "seq", "command", "output_bytes")


# ---- filters -------------------------------------------------------------------------------------

@query("quick_skip", "select conv_id, turn, strlen(text) < 1000 and not regexp_matches(text, '" + "|".join(filters.quote(k) for k in filters.KEYWORDS) + "') as skip from conversations")
def _quick_skip(spark, sf):
    return ingest.table(spark, sf, "conversations").select("conv_id", "turn", filters.is_quick_skip(F.col("text")).alias("skip"))


_KEEP = f"""
v as ({LOG}),
k as (select *, max(case when regexp_matches(lower(line), '{"|".join(filters.TRIGGERS)}') then 1 else 0 end) over (partition by source_id order by line_no rows between 1 preceding and 1 following) = 1
      or regexp_matches(lower(line), '{"|".join(filters.METADATA)}') as keep from v),
g as (select *, sum(case when keep then 1 else 0 end) over (partition by source_id order by line_no) as run from k)"""


@query("ai_line_filter", f"""with {_KEEP}
select source_id, line_no, line from g where keep
union all select source_id, min(line_no), '... Skipped ' || count(*) || ' normal build lines ...' from g where not keep group by source_id, run""")
def _ai_lines(spark, sf):
    return filters.ai_lines(log_view(spark, sf))


@query("ai_skip_runs", f"with {_KEEP} select source_id, cast(count(*) as bigint) as runs, cast(sum(n) as bigint) as skipped from (select source_id, run, count(*) as n from g where not keep group by all) group by source_id")
def _ai_runs(spark, sf):
    n = F.regexp_extract("line", "^\\.\\.\\. Skipped ([0-9]+) normal build lines", 1).try_cast("bigint")
    return filters.ai_lines(log_view(spark, sf)).withColumn("n", n).where("n is not null").groupBy("source_id").agg(F.count(F.lit(1)).alias("runs"), F.sum("n").alias("skipped"))


@query("keep_drop", f"with v as ({LOG}) select source_id, line_no, line from v where regexp_matches(line, 'user=1|ERROR') and not regexp_matches(line, 'mod3')")
def _keep_drop(spark, sf):
    return log_view(spark, sf).where(filters.keep_drop(F.col("line"), ["user=1", "ERROR"], ["mod3"]))


@query("rule_sections", f"""with v as ({LOG}),
m as (select *, case when regexp_matches(line, 'signup') then 'o' when regexp_matches(line, 'purchase') then 'c' end as mark from v),
s as (select *, last_value(mark ignore nulls) over (partition by source_id order by line_no rows between unbounded preceding and 1 preceding) as was from m)
select source_id, line_no, line from s where was = 'o' and coalesce(mark, '') <> 'c'""")
def _sections(spark, sf):
    return filters.section(log_view(spark, sf), "signup", "purchase")


@query("blank_collapse", f"with v as ({LOG}), p as (select *, coalesce(trim(lag(line) over (partition by source_id order by line_no)) = '', false) as b from v) select source_id, line_no, line from p where not (b and trim(line) = '')")
def _blank(spark, sf):
    return filters.collapse_blank(log_view(spark, sf))


@query("error_lines", f"with v as ({LOG}) select source_id, line_no, line from v where regexp_matches(lower(line), 'error|fatal|panic|failed|rollback')")
def _errors(spark, sf):
    return log_view(spark, sf).where(filters.is_error(F.col("line")))


@query("line_predicates", f"""with {LINES} select source_id, cast(count(*) filter (regexp_matches(line, '^(Generating|Copying|Checking|Installing|Skiped|skipping)')) as bigint) as noise,
cast(count(*) filter (regexp_matches(ltrim(line), '^(--- |\\+\\+\\+ |\\*\\*\\* |=== |Index: |diff --git )')) as bigint) as heads from lines group by source_id""")
def _predicates(spark, sf):
    return doc_lines(spark, sf).groupBy("source_id").agg(F.count_if(filters.is_noise(F.col("line"))).alias("noise"), F.count_if(filters.is_diff_header(F.col("line"))).alias("heads"))


@query("keep_error_signal", f"""with v as ({LOG}), t as (select source_id, string_agg(line, chr(10) order by line_no) as raw, min(line) filter (line <> '') as c,
 (array_agg(line order by line_no) filter (regexp_matches(lower(line), 'error|fatal|panic')))[1] as e from v group by source_id)
select source_id, case when regexp_matches(lower(raw), 'error|fatal|panic') and not regexp_matches(lower(c), 'error|fatal|panic') then c || chr(10) || e else c end as text from t""")
def _keep_error(spark, sf):
    t = log_view(spark, sf).groupBy("source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("raw"), F.min(F.when(F.col("line") != "", F.col("line"))).alias("c"))
    return t.select("source_id", filters.keep_error_signal(F.col("raw"), F.col("c")).alias("text"))


@query("roi_gate", "select doc_id, case when strlen(trim(replace(text, ' ', '  '))) > strlen(trim(text)) or strlen(replace(text, ' ', '  ')) > strlen(text) then text else replace(text, ' ', '  ') end as text from documents")
def _roi(spark, sf):
    return docs(spark, sf).select("doc_id", filters.prefer_smaller(F.col("text"), F.replace("text", F.lit(" "), F.lit("  "))).alias("text"))


@query("head_tail", f"""with {LINES}, r as (select *, row_number() over (partition by source_id order by line_no) as rank, count(*) over (partition by source_id) as total from lines)
select source_id, rank, line from r where total <= 10 or rank <= 5 or rank > total - 5
union all select distinct source_id, 6, '... ' || (total - 10) || ' lines omitted ...' from r where total > 10""")
def _head_tail(spark, sf):
    return filters.head_tail(doc_lines(spark, sf))


_SAFE = [("hidden_unicode", f"W_SAFETY_HIDDEN_UNICODE:{lab}", f"contains(text, chr({ord(c)}))") for c, lab in filters.HIDDEN]
_SAFE += [("prompt_injection", f"W_SAFETY_PROMPT_INJECTION:{p}", f"contains(lower(text), '{p}')") for p in filters.INJECTIONS]
_SAFE += [("shell_injection", f"W_SAFETY_SHELL_META:{p}", f"contains(text, '{p}')") for p in filters.SHELL]


@query("safety_warnings", " union all ".join(f"select doc_id, '{c}' as \"check\", '{m}' as message from documents where {p}" for c, m, p in _SAFE))
def _safety(spark, sf):
    return filters.safety_warnings(docs(spark, sf), "doc_id")


@query("uniq_adjacent", f"with {LINES}, p as (select *, lag(line) over (partition by source_id order by line_no) as prev from lines) select source_id, line_no, line from p where line is distinct from prev")
def _uniq(spark, sf):
    return filters.adjacent_unique(doc_lines(spark, sf))


# ---- slices and classes --------------------------------------------------------------------------

@query("line_slices", f"with {LINES} select source_id, line_no as slice_no, 'Line' as slice_type, line_no as line_start, line_no as line_end, line as text from lines")
def _line_slices(spark, sf):
    return slicing.line_slices(doc_lines(spark, sf))


@query("paragraphs", f"""with v as ({LOG}), i as (select *, sum(case when trim(line) = '' then 1 else 0 end) over (partition by source_id order by line_no) as island from v)
select source_id, min(line_no) as slice_no, 'Paragraph' as slice_type, min(line_no) as line_start, max(line_no) as line_end, count(*) as n_lines, string_agg(line, chr(10) order by line_no) as text
from i where trim(line) <> '' group by source_id, island""")
def _paragraphs(spark, sf):
    return slicing.paragraphs(log_view(spark, sf))


@query("newline_slices", f"""with v as ({LOG}), i as (select *, sum(case when trim(line) <> '' then 1 else 0 end) over (partition by source_id order by line_no) as island from v)
select source_id, min(line_no) as line_start, least(count(*), 2) as newlines from i where trim(line) = '' group by source_id, island""")
def _newlines(spark, sf):
    return slicing.newline_slices(log_view(spark, sf))


@query("hybrid_slices")
def _hybrid(spark, sf):
    return slicing.hybrid(ingest.lines(ingest.table(spark, sf, "pages"), "page_id", "html"))


@query("tag_blocks", """select page_id, case when starts_with(trim(html), '<!DOCTYPE') or starts_with(trim(html), '<html') then 'HtmlBlock' when starts_with(trim(html), '<?xml') then 'XmlBlock' else 'other' end as kind from pages""")
def _tags(spark, sf):
    return ingest.table(spark, sf, "pages").select("page_id", F.coalesce(slicing.tag_type(F.col("html")), F.lit("other")).alias("kind"))


@query("slice_flags", f"""with v as ({LOG}) select source_id, line_no, contains(line, '/') as has_paths, regexp_matches(line, '{slicing.STACK}') as has_stack_trace, regexp_matches(line, '{slicing.HEADER}') as has_log_headers from v""")
def _flags(spark, sf):
    return log_view(spark, sf).withColumn("f", slicing.flags(F.col("line"))).select("source_id", "line_no", "f.has_paths", "f.has_stack_trace", "f.has_log_headers")


@query("indent_blocks", f"with {LINES} select source_id, count(*) filter (regexp_matches(line, '^[ \\t]+[^ \\t]')) as indented from lines group by source_id")
def _indent(spark, sf):
    return doc_lines(spark, sf).groupBy("source_id").agg(F.count_if(slicing.is_indented(F.col("line"))).alias("indented"))


def _texts(spark, sf):
    """Documents, pages, turns and log lines as one table (id, text)."""
    conv = ingest.table(spark, sf, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"), "text")
    pages = ingest.table(spark, sf, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.col("html").alias("text"))
    log = log_view(spark, sf).select(F.concat(F.lit("l"), F.col("line_no").cast("string")).alias("id"), F.col("line").alias("text"))
    return docs(spark, sf).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text").unionByName(conv).unionByName(pages).unionByName(log)


TEXTS = f"""texts as (select 'd' || doc_id as id, text from documents union all select 'c' || conv_id || '-' || turn, text from conversations
union all select 'p' || page_id, html from pages union all select 'l' || line_no, line from ({LOG}) v)"""
_SCORES = ", ".join(
    "case when ({s}) > 0 then ({s}) + least(strlen(text) / 1000.0, 1.0) * 0.2 else 0.0 end as s{i}".format(i=i, s=" + ".join(f"case when regexp_matches(text, '{p}') then {w} else 0.0 end" for _, p, k, w in classify.RULES if k == t))
    for i, t in enumerate(classify.TYPES))
_BEST = "greatest(" + ", ".join(f"s{i}" for i in range(len(classify.TYPES))) + ")"


@query("classify_slices", f"""with {TEXTS}, s as (select id, {_SCORES} from texts), b as (select *, round(least({_BEST}, 1.0), 6) as conf from s)
select id, case when conf >= 0.5 then case {" ".join(f"when s{i} = {_BEST} then '{t}'" for i, t in enumerate(classify.TYPES))} end else 'Unknown' end as slice_type,
cast(case when conf >= 0.5 then conf else 0.0 end as double) as confidence from b""")
def _classify(spark, sf):
    return _texts(spark, sf).withColumn("a", classify.analyze(F.col("text"))).select("id", "a.slice_type", "a.confidence")


@query("script_detect", """select doc_id, case when length(text) = 0 then 'Unknown' else 'Latin' end as primary_script, case when length(text) = 0 then 0.0 else 1.0 end as confidence, false as mixed from documents""")
def _scripts(spark, sf):
    return docs(spark, sf).withColumn("s", classify.scripts(F.col("text"))).select("doc_id", "s.primary_script", "s.confidence", "s.mixed")


@query("script_detect_mixed", "select * from (values (0, 'Latin', 0.5, false), (1, 'Cyrillic', 1.0, false), (2, 'Latin', 0.666667, false), (3, 'Unknown', 0.0, false), (4, 'Latin', 0.333333, true)) t(k, primary_script, confidence, mixed)")
def _scripts_mixed(spark, sf):
    return spark.createDataFrame([(0, "中文ab文字cd"), (1, "Привет"), (2, "abcdかな"), (3, ""), (4, "aaaaααααжжжж")], "k int, t string").withColumn("s", classify.scripts(F.col("t"))).select("k", "s.primary_script", "s.confidence", "s.mixed")


@query("quick_analyze", "select * from (values (0,'CodeBlock',0.9),(1,'LogBlock',0.9),(2,'VueComponent',0.7),(3,'Unknown',0.3),(4,'CodeBlock',0.8)) t(k, slice_type, confidence)")
def _quick(spark, sf):
    rows = [(0, "a/b.RS", "x", False), (1, "x.log", "", False), (2, "", "<p v-if='a'>", False), (3, "", "plain", False), (4, "", "com.a.b", True)]
    return spark.createDataFrame(rows, "k int, p string, t string, known boolean").withColumn("q", classify.quick(F.col("p"), F.col("t"), F.col("known"))).select("k", "q.slice_type", F.col("q.confidence").cast("decimal(2,1)").alias("confidence"))


@query("vocabulary", "select k, c from (values (0,'unix_path'),(1,'java_package'),(2,'maven_coord'),(3,'macro_ref'),(4,'gradle_path'),(5,'windows_path'),(6,null)) t(k, c)")
def _vocabulary(spark, sf):
    return spark.createDataFrame([(0, "/usr/lib"), (1, "com.acme.app"), (2, "org:lib:1.0"), (3, "$HOME_DIR"), (4, ":app:debug"), (5, "C:\\x"), (6, "word")], "k int, t string").select("k", classify.vocabulary_category(F.col("t")).alias("c"))


def _formats():
    from ..operators.formats.catalog import FORMATS

    return list(FORMATS)


@query("route_argmax")
def _route(spark, sf):
    return classify.route(_texts(spark, sf), "text", _formats()).select("id", "plugin", "confidence", "parse_tier", "parse_reason")


@query("route_ranked")
def _ranked(spark, sf):
    return classify.ranking(docs(spark, sf), "doc_id", "text", _formats())


@query("match_share", f"""with a as (select doc_id, string_split(text, chr(10))[1:20] as h from documents) select doc_id, len(list_filter(h, lambda x: regexp_matches(x, '[0-9]'))) / len(h) > 0.15 as hit from a""")
def _share(spark, sf):
    return docs(spark, sf).select("doc_id", classify.match_share(F.col("text"), ["[0-9]"]).alias("hit"))


# ---- reduction -----------------------------------------------------------------------------------

@query("dedup_lines_refs", f"with {DEDUP} select source_id, line_no as seq, kind, value from tok")
def _dedup(spark, sf):
    return reduce.dedup_lines(doc_lines(spark, sf))[0]


@query("dedup_dictionary", f"with {DEDUP} select '$M' || id as token, line as value, case when regexp_matches(lower(line), 'error|fail') then 'Semantic' else 'Noise' end as category from dict")
def _dictionary(spark, sf):
    return reduce.dedup_lines(doc_lines(spark, sf))[1].select("token", "value", "category")


@query("dedup_summary", f"""with {DEDUP}
select s.source as grp, count(*) as n_lines, count(*) filter (kind = 'ref') as n_refs, cast(sum(strlen(line) + 1) as bigint) as bytes_in, cast(sum(strlen(value) + 1) as bigint) as bytes_out,
cast(sum(case when kind = 'ref' then 1 else strlen(value) // 4 end) as bigint) as tokens_out, round(sum(strlen(value) + 1) / sum(strlen(line) + 1), 6) as ratio
from tok join documents s on s.doc_id = tok.source_id group by s.source""")
def _summary(spark, sf):
    lines = doc_lines(spark, sf)
    tokens, dictionary = reduce.dedup_lines(lines)
    return reduce.summary(lines, docs(spark, sf).select(F.col("doc_id").alias("source_id"), F.col("source").alias("grp")), tokens, dictionary)


@query("dedup_docs_exact", "with r as (select doc_id, text, min(doc_id) over (partition by text) as first, count(*) over (partition by text) as n from documents) select doc_id, first, n from r where n > 1")
def _docs_exact(spark, sf):
    own = docs(spark, sf).select("doc_id", F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))
    g = own.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return own.join(g, ["a", "b"]).select("doc_id", "first", "n")


@query("dict_roundtrip", f"with {LINES} select source_id, string_agg(line, chr(10) order by line_no) as text from lines group by source_id")
def _roundtrip(spark, sf):
    tokens, dictionary = reduce.dedup_lines(doc_lines(spark, sf))
    return inverse.assemble(inverse.resolve(tokens, dictionary))


@query("resolve_for_ai", f"with {DEDUP} select source_id, line_no as seq, case when kind = 'ref' and not regexp_matches(lower(line), 'error|fail|exception|warning') then 'dropped' else 'text' end as kind, case when kind = 'ref' and not regexp_matches(lower(line), 'error|fail|exception|warning') then '' else line end as value from tok")
def _resolve_ai(spark, sf):
    tokens, dictionary = reduce.dedup_lines(doc_lines(spark, sf))
    return inverse.resolve_for_ai(tokens, dictionary).drop("dropped")


@query("resolve_recursive", "select * from (values ('$M0','a /srv/x/y b'),('$P1','/srv/x/y'),('$D2','/srv/x'),('$PK1','com.acme')) t(token, value)")
def _recursive(spark, sf):
    return inverse.expand(spark.createDataFrame([("$M0", "a $P1 b"), ("$P1", "$D2/y"), ("$D2", "/srv/x"), ("$PK1", "com.acme")], "token string, value string"))


@query("token_estimates", "select doc_id, strlen(text) as bytes, cast(strlen(text) // 4 as bigint) as tokens from documents")
def _tokens(spark, sf):
    return docs(spark, sf).select("doc_id", F.octet_length("text").cast("bigint").alias("bytes"), reduce.token_estimate(F.lit("text"), F.col("text")).alias("tokens"))


@query("fuse_tokens", f"""with {DEDUP}, g as (select *, sum(case when kind = 'ref' then 1 else 0 end) over (partition by source_id order by line_no) as refs from tok)
select source_id, min(line_no) as seq, kind, string_agg(value, chr(10) order by line_no) as value from g group by source_id, refs, kind, case when kind = 'ref' then line_no else -1 end""")
def _fuse(spark, sf):
    return reduce.fuse(reduce.dedup_lines(doc_lines(spark, sf))[0])


_PATHS = f"""v as ({LOG}), p as (select source_id, line_no, regexp_extract(line, 'path=(/[^ ]+)', 1) as path from v where line <> '')"""


@query("path_dictionary", f"with {_PATHS}, f as (select path, count(*) as n, min((source_id, line_no)) as first from p group by path) select '$P' || (row_number() over (order by first) - 1) as token, path as value, n from f")
def _path_dict(spark, sf):
    paths = reduce.paths_in(log_view(spark, sf).withColumn("line", F.regexp_replace("line", "path=", "path: ")), reduce.UNIX_PATH)
    return reduce.dictionary_of(paths, "path", "path", "source_id", "line_no").select("token", "value", "n")


@query("path_prefix_counts", f"""with {_PATHS}, d as (select distinct string_split(path[2:], '/') as a from p), x as (select '/' || array_to_string(a[1:k], '/') as prefix from d, unnest(generate_series(1, len(a))) t(k)),
q as (select distinct prefix from x), c as (select prefix, count(*) as n from x group by prefix), ch as (select regexp_extract(prefix, '^(.*)/[^/]*$', 1) as prefix, count(*) as children from q group by 1)
select q.prefix, q2.n, coalesce(ch.children, 0) as children from q join (select prefix, count(*) as n from (select distinct array_to_string(a, '/') as full_, '/' || array_to_string(a[1:k], '/') as prefix from d, unnest(generate_series(1, len(a))) t(k)) group by prefix) q2 using (prefix) left join ch on ch.prefix = q.prefix""")
def _prefixes(spark, sf):
    return reduce.hierarchy(_log_paths(spark, sf))


def _log_paths(spark, sf):
    return log_view(spark, sf).where("line <> ''").select("source_id", "line_no", F.regexp_extract("line", "path=(/[^ ]+)", 1).alias("path"))


@query("path_layered", f"""with {_PATHS}, x as (select *, regexp_extract(path, '^(.*)/[^/]+$', 1) as dir, regexp_extract(path, '^.*/([^/]+)$', 1) as leaf from p),
d as (select dir, row_number() over (order by min((source_id, line_no))) - 1 as id from x where strlen(dir) >= 10 group by dir)
select source_id, line_no, coalesce('$P' || id || '/' || leaf, path) as layered from x left join d on x.dir = d.dir""")
def _layered(spark, sf):
    return reduce.layered(_log_paths(spark, sf), "path", "source_id", "line_no")[0].select("source_id", "line_no", "layered")


@query("path_skeleton", f"with {_PATHS} select source_id, line_no, case when len(list_filter(string_split(path, '/'), lambda x: x <> '')) > 2 then list_filter(string_split(path, '/'), lambda x: x <> '')[1] || '/.../' || string_split(path, '/')[-1] else path end as short from p")
def _skeleton(spark, sf):
    return _log_paths(spark, sf).select("source_id", "line_no", reduce.skeleton_path(F.col("path")).alias("short"))


@query("path_shorten", "select * from (values (0, 'x .../dddddddddd/eeeeeeeeee/f.c y'), (1, 'x /a/b.c y')) t(k, s)")
def _shorten(spark, sf):
    return spark.createDataFrame([(0, "x /aaaaaaaaaa/bbbbbbbbbb/cccccccccc/dddddddddd/eeeeeeeeee/f.c y"), (1, "x /a/b.c y")], "k int, t string").select("k", reduce.shorten_paths(F.col("t")).alias("s"))


@query("replace_paths")
def _replace_paths(spark, sf):
    return reduce.replace_paths(log_view(spark, sf).withColumn("line", F.regexp_replace("line", "path=", "path: ")))[0]


@query("trie_directories")
def _trie(spark, sf):
    hrefs = ingest.table(spark, sf, "pages").select(F.explode(F.regexp_extract_all("url", F.lit("https?://([^?#]*)"), F.lit(1))).alias("u")).select(F.concat(F.lit("/"), "u").alias("path"))
    return reduce.directories(_log_paths(spark, sf).select("path").unionByName(hrefs), busy=3, gap=6)


@query("unique_prefixes", "with h as (select distinct sha256(text) as hash from documents), n as (select hash, lag(hash) over (order by hash) as p, lead(hash) over (order by hash) as n from h), k as (select hash, (select coalesce(max(i), 0) from unnest(generate_series(1, 64)) t(i) where hash[1:i] = coalesce(p, '')[1:i]) as a, (select coalesce(max(i), 0) from unnest(generate_series(1, 64)) t(i) where hash[1:i] = coalesce(n, '')[1:i]) as b from n) select hash, hash[1:greatest(a + 1, b + 1, 4)] as short from k")
def _unique(spark, sf):
    return reduce.unique_prefixes(docs(spark, sf).select(F.sha2(F.encode("text", "UTF-8"), 256).alias("hash")), "hash", 4)


@query("directory_trees")
def _trees(spark, sf):
    return reduce.trees(_log_paths(spark, sf), "source_id", "path")


@query("inline_paths")
def _inline(spark, sf):
    texts = _log_paths(spark, sf).groupBy("source_id").agg(F.array_join(F.sort_array(F.collect_set("path")), "\n").alias("text"))
    return texts.withColumn("r", reduce.inline_paths("text")).select("source_id", F.length("r.text").alias("n"), "r.footer")


# ---- templates -----------------------------------------------------------------------------------

_DRAIN = r"list_filter(string_split_regex(line, '[ =,:;\[\]()]'), lambda x: x <> '')"


@query("template_keys", f"with v as ({LOG}) select source_id, line_no, len({_DRAIN}) as n, {_DRAIN}[2] as second from v")
def _keys(spark, sf):
    return log_view(spark, sf).select("source_id", "line_no", F.size(templates.tokens(F.col("line"))).cast("bigint").alias("n"), F.get(templates.tokens(F.col("line")), F.lit(1)).alias("second"))


@query("template_mine")
def _mine(spark, sf):
    return templates.mine(log_view(spark, sf)).select(F.array_join("template", " ").alias("text"), "size", "first_source", "first_line")


@query("template_topn")
def _topn(spark, sf):
    own = log_view(spark, sf).where(F.trim("line") != "").withColumn("line", templates.without_time(F.col("line")))
    return templates.top_templates(templates.mine(own))


# ---- normalisation -------------------------------------------------------------------------------

@query("xml_minify", "select page_id, regexp_replace(html, '>[ \\t\\r\\n]+<', '><', 'g') as html from pages")
def _minify(spark, sf):
    return ingest.table(spark, sf, "pages").select("page_id", N.minify_tags(F.col("html")).alias("html"))


@query("strip_tags", "select page_id, regexp_replace(html, '<[^>]*>', '', 'g') as text from pages")
def _strip(spark, sf):
    return ingest.table(spark, sf, "pages").select("page_id", N.strip_tags(F.col("html")).alias("text"))


@query("strip_comments", "select page_id, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') as html from pages")
def _comments(spark, sf):
    return ingest.table(spark, sf, "pages").select("page_id", N.strip_comments(F.col("html")).alias("html"))


_ROUTE = "'/' || array_to_string(list_transform(list_filter(string_split(string_split(case when regexp_matches(trim({u}), '^https?://') then case when regexp_extract(trim({u}), '^https?://[^/]*(/.*)$', 1) = '' then '/' else regexp_extract(trim({u}), '^https?://[^/]*(/.*)$', 1) end else trim({u}) end, '?')[1], '/'), lambda x: x <> ''), lambda p: case when regexp_matches(p, '^[0-9]{{4,}}$') or regexp_matches(p, '^[0-9a-fA-F-]{{16,}}$') then ':id' else p end), '/')"


@query("route_normalize", f"select page_id, {_ROUTE.format(u='url')} as route from pages")
def _routes(spark, sf):
    return ingest.table(spark, sf, "pages").select("page_id", N.normalize_route(F.col("url")).alias("route"))


@query("top_routes", f"select {_ROUTE.format(u='url')} as route, count(*) as n from pages group by 1 order by n desc, route limit 10")
def _top_routes(spark, sf):
    return reorder.top_counts(ingest.table(spark, sf, "pages").select(N.normalize_route(F.col("url")).alias("route")), "route", 10)


@query("hex_mask", """select doc_id, 'sum ' || sha256(coalesce(text, '')) || ': ' || case when doc_id % 3 = 0 then '[HEX_DUMP: ' || 4 * 64 || ' chars]' else sha256(coalesce(text, '')) || 'x' end || '.' as text from documents""")
def _hex(spark, sf):
    h = F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)
    t = F.concat(F.lit("sum "), h, F.lit(": "), F.when(F.col("doc_id") % 3 == 0, F.repeat(h, F.lit(4))).otherwise(F.concat(h, F.lit("x"))), F.lit("."))
    return docs(spark, sf).select("doc_id", N.mask_hex(t).alias("text"))


@query("hex_dictionary", """with h as (select doc_id, sha256(coalesce(text, '')) as h from documents), d as (select h, row_number() over (order by min(doc_id)) - 1 as id from h group by h)
select doc_id as source_id, 'sum $P' || id || ' of ' || strlen(h.h) * 3 || case when doc_id % 2 = 0 then ' [HEX_DUMP: 192 chars]' else '' end as line from h join d using (h)""")
def _hex_dictionary(spark, sf):
    h = F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)
    own = F.concat(F.lit("sum "), h, F.lit(" of 192"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" "), F.repeat(h, F.lit(3)))).otherwise(""))
    return reduce.hex_dictionary(docs(spark, sf).select(F.col("doc_id").alias("source_id"), F.lit(1).cast("bigint").alias("line_no"), own.alias("line")))[0].select("source_id", "line")


@query("binary_marker", "select doc_id, '[BINARY_DATA: Size=' || strlen(text) || 'B, MD5=' || left(md5(text), 8) || ']' as marker from documents")
def _marker(spark, sf):
    return docs(spark, sf).select("doc_id", N.binary_marker(F.col("text")).alias("marker"))


@query("normalize_line", f"with v as ({LOG}) select source_id, line_no, regexp_replace(regexp_replace(replace(line, chr(92), '/'), '0x[0-9a-fA-F]{{8,16}}', '0x[ADDR]', 'g'), '\\b[0-9a-fA-F]{{32,40}}\\b', '/[HASH]/', 'g') as line from v")
def _normalize(spark, sf):
    return log_view(spark, sf).select("source_id", "line_no", N.normalize_line(F.col("line")).alias("line"))


@query("flags_sort", "select * from (values (0,'gcc x.c -DA -Iinc -O2 -Wall'),(1,'no flags'),(2,'ld a.o -lfoo -Llib'),(3,'-I')) t(k, s)")
def _flags_sort(spark, sf):
    return spark.createDataFrame([(0, "gcc -Wall -I inc x.c -O2 -DA"), (1, "no flags"), (2, "ld a.o -L lib -lfoo"), (3, "-I")], "k int, t string").select("k", N.sort_flags(F.col("t")).alias("s"))


@query("json_canonical", "select event_id, '{\"k\":' || (props::json->>'k') || '}' as json from events")
def _json(spark, sf):
    return ingest.table(spark, sf, "events").select("event_id", N.canonical_json(F.col("props")).alias("json"))


@query("json_fields", "select event_id, cast(props::json->>'k' as bigint) as k from events")
def _fields(spark, sf):
    return ingest.table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("json_extract", f"with v as ({LOG}) select source_id, line_no, case when line <> '' then regexp_extract(line, '\\{{.*\\}}') end as json from v")
def _extract(spark, sf):
    return log_view(spark, sf).select("source_id", "line_no", N.extract_json("line").alias("json"))


@query("sql_skeleton", "select * from (values (0, 'select * from t where name = ''?'' and age > ? and city = ''?'''), (1, 'short 1')) t(k, s)")
def _skeleton_sql(spark, sf):
    return spark.createDataFrame([(0, "select * from t where name = 'bob' and age > 42 and city = 'x y'"), (1, "short 1")], "k int, t string").select("k", N.sql_skeleton(F.col("t")).alias("s"))


@query("ansi_strip", "select doc_id, text from documents")
def _ansi(spark, sf):
    return docs(spark, sf).select("doc_id", N.strip_ansi(F.concat(F.lit("\x1b[31m"), "text", F.lit("\x1b[0m"))).alias("text"))


@query("cr_last", "select doc_id, regexp_extract(text, '[^\\n]*$') as line from documents")
def _cr(spark, sf):
    return docs(spark, sf).select("doc_id", N.last_redraw(F.replace("text", F.lit("\n"), F.lit("\r"))).alias("line"))


@query("relative_time", f"""with v as ({LOG}), t as (select *, epoch_ms(try_cast(regexp_extract(line, '^\\[([^\\]]*)Z\\]', 1) as timestamp)) as ms from v where line <> '')
select source_id, line_no, ms - first_value(ms) over (partition by source_id order by line_no) as rel from t""")
def _relative(spark, sf):
    own = log_view(spark, sf).where("line <> ''").withColumn("ms", N.bracket_time(F.col("line")))
    base = own.groupBy("source_id").agg(F.min_by("ms", "line_no").alias("base"))
    return own.join(base, "source_id").select("source_id", "line_no", (F.col("ms") - F.col("base")).alias("rel"))


@query("access_classes", f"""with a as ({ACCESS}) select line_no, case when regexp_matches(status, '^[2-5]') then status[1:1] || 'xx' else 'other' end as bucket, 'Internal' as ip_class,
case when ua = '-' then 'Unknown' when contains(lower(ua), 'kube-probe') then 'Health/Kubernetes' when contains(lower(ua), 'googlebot') then 'Bot/Google' when contains(lower(ua), 'curl/') then 'Bot/Script' when contains(lower(ua), 'mozilla/') then 'Browser' else 'Other' end as ua_class from a""")
def _classes(spark, sf):
    return access_view(spark, sf).select("line_no", N.status_bucket(F.col("status")).alias("bucket"), N.ip_class(F.col("ip")).alias("ip_class"), N.agent_class(F.col("ua")).alias("ua_class"))


@query("compact_values", f"with v as ({LOG}) select source_id, line_no, case when strlen(line) > 40 then left(line, 40) || '...' else line end as cut, trim(regexp_replace(line, '[ \\t\\r\\n]+', ' ', 'g')) as tight from v")
def _compact(spark, sf):
    return log_view(spark, sf).select("source_id", "line_no", N.trim_to(F.col("line"), 40).alias("cut"), N.compact_spaces(F.col("line")).alias("tight"))


# ---- web -----------------------------------------------------------------------------------------

_WEB = f"""a as ({ACCESS}), r as (select *, {_ROUTE.format(u='path')} as route, case when regexp_matches(status, '^[2-5]') then status[1:1] || 'xx' else 'other' end as bucket from a),
k as (select *, case when regexp_matches(lower(route), '/health|/ready|/live') or lower(route) = '/ping' or regexp_matches(lower(ua), 'kube-probe|elb-healthchecker') then 'health'
 when regexp_matches(lower(route), '\\.(js|css|png|jpg|jpeg|gif|svg|ico|map|woff|woff2)$') then 'static' when regexp_matches(lower(ua), 'googlebot|bingbot|python-requests|curl/|wget/|go-http-client') then 'bot' else 'routine' end as kind from r)"""


@query("web_summary", f"""with {_WEB} select count(*) as records, min_by(time, line_no) as first_time, max_by(time, line_no) as last_time, {", ".join(f"count(*) filter (bucket = '{b}') as n_{b}" for b in ('2xx', '3xx', '4xx', '5xx', 'other'))},
count(distinct ip) as ips, count(distinct route) as urls, count(distinct ua) as uas, cast(coalesce(sum(try_cast(bytes as bigint)), 0) as bigint) as bytes_total from k""")
def _web_summary(spark, sf):
    return web.summary(access_view(spark, sf))


@query("web_top", f"""with {_WEB}, d as (select 'status' as dimension, status as value from k union all select 'method', method from k union all select 'source', source from k union all select 'ip', ip from k union all select 'ua', ua from k
 union all select 'url', method || ' ' || route from k union all select 'referer', referer from k where referer not in ('-', '')), c as (select dimension, value, count(*) as n from d group by all),
q as (select *, row_number() over (partition by dimension order by n desc, value) as r from c)
select dimension, case when strlen(value) > 80 then left(value, 80) || '...' else value end as value, n from q where r <= case dimension when 'status' then 8 when 'method' then 6 when 'source' then 4 when 'url' then 8 when 'ip' then 8 else 6 end""")
def _web_top(spark, sf):
    return web.tops(access_view(spark, sf))


@query("web_anomalies", f"""with {_WEB}, e as (select *, status || ' ' || method || ' ' || route as anomaly from k where regexp_matches(status, '^[45]')), g as (select anomaly, count(*) as hits, min_by(path, line_no) as sample from e group by anomaly order by hits desc, anomaly limit 8),
i as (select anomaly, ip, count(*) as n from e where anomaly in (select anomaly from g) group by all), t as (select *, row_number() over (partition by anomaly order by n desc, ip) as r from i)
select g.anomaly, hits, string_agg(ip || ':' || n, ',' order by n desc, ip) as ips, sample from g join t on g.anomaly = t.anomaly and r <= 5 group by g.anomaly, hits, sample""")
def _web_anomalies(spark, sf):
    return web.anomalies(access_view(spark, sf))


@query("web_slow", f"with {_WEB} select line_no, method, route, status, duration_ms, ip, case when strlen(ua) > 60 then left(ua, 60) || '...' else ua end as ua from k where duration_ms >= 1000 order by duration_ms desc, line_no limit 5")
def _web_slow(spark, sf):
    return web.slow(access_view(spark, sf))


@query("web_routines", f"""with {_WEB} select kind, status, method, route, count(*) as n, count(distinct ip) as ips, count(distinct ua) as uas, cast(floor(sum(duration_ms) / count(duration_ms)) as bigint) as avg_ms from k where not regexp_matches(status, '^[45]')
group by kind, status, method, route having count(*) >= 2 or kind <> 'routine' order by n desc, kind, route, status, method limit 8""")
def _web_routines(spark, sf):
    return web.routines(access_view(spark, sf))


@query("web_scans", f"""with {_WEB} select ip, ua, count(*) as targets, count(distinct route) as routes, count(*) filter (regexp_matches(lower(route), '\\.env|wp-|wp/|admin|config|backup|phpmyadmin|\\.git|passwd|secret')) as sensitive, min_by(time, line_no) as first_time, max_by(time, line_no) as last_time
from k where status in ('403', '404') group by ip, ua having targets >= 5 and (routes >= 4 or sensitive >= 2) order by ip || '|' || ua limit 5""")
def _web_scans(spark, sf):
    return web.scans(access_view(spark, sf))


@query("web_bursts", f"""with {_WEB} select status, method, route, count(*) as n, count(distinct ip) as ips, min_by(time, line_no) as first_time, max_by(time, line_no) as last_time from k where starts_with(status, '5')
group by status, method, route having count(*) >= 3 order by status || '|' || method || '|' || route limit 5""")
def _web_bursts(spark, sf):
    return web.bursts(access_view(spark, sf))


@query("web_diag", f"""with {_WEB}, g as (select count(*) as records, count(*) filter (bucket = '4xx') as n_4xx, count(*) filter (bucket = '5xx') as n_5xx, count(*) filter (kind = 'health') as health, count(*) filter (kind = 'static') as static, count(*) filter (kind = 'bot') as bot from k)
select *, round((n_4xx + n_5xx) * 100.0 / records, 1) as err_rate from g where records >= 24""")
def _web_diag(spark, sf):
    return web.diagnosis(access_view(spark, sf))


@query("web_tokens", f"""with {_WEB}, c as (select ua, count(*) as n from k group by ua order by n desc, ua limit 10), b as (select *, row_number() over (order by n desc, ua) as place,
case when contains(lower(ua), 'kube-probe') then '$UA_KUBE' when contains(lower(ua), 'googlebot') then '$UA_BOT_GOOGLE' when contains(lower(ua), 'curl/') then '$UA_CLI' when contains(lower(ua), 'mozilla/') then '$UA_BROWSER' else '$UA' end as base from c)
select ua, n, case when row_number() over (partition by base order by place) = 1 then base else base || place end as token from b""")
def _web_tokens(spark, sf):
    return web.agent_tokens(access_view(spark, sf))


@query("web_ip_tokens", f"""with {_WEB}, s as (select ip, ua, count(*) as targets, count(distinct route) as routes, count(*) filter (regexp_matches(lower(route), '\\.env|wp-|wp/|admin|config|backup|phpmyadmin|\\.git|passwd|secret')) as sensitive
 from k where status in ('403', '404') group by ip, ua having targets >= 5 and (routes >= 4 or sensitive >= 2) order by ip || '|' || ua limit 1),
c as (select ip, count(*) as n from k group by ip order by n desc, ip limit 10), p as (select c.ip, n, s.ip is not null as atk from c left join s on c.ip = s.ip)
select ip, n, case when atk then '$IP_ATK' else '$IP' || sum(case when atk then 0 else 1 end) over (order by n desc, ip) end as token from p""")
def _web_ips(spark, sf):
    return web.ip_tokens(access_view(spark, sf))


@query("web_compact", f"with {_WEB} select count(*) filter (bucket in ('4xx','5xx') or coalesce(duration_ms, 0) >= 1000) = 0 and count(distinct route) = 1 as compact from k")
def _web_compact(spark, sf):
    return web.is_plain_health(access_view(spark, sf))


# ---- reordering ----------------------------------------------------------------------------------

_CTX = f"""v as ({LOG}), c as (select *, case when regexp_matches(line, '^\\[([a-zA-Z0-9_-]+)\\]') then 'bracket_tag:' || regexp_extract(line, '^\\[([a-zA-Z0-9_-]+)\\]', 1) when regexp_matches(line, 'user=([0-9]+)') then 'user:' || regexp_extract(line, 'user=([0-9]+)', 1) end as own from v),
f as (select *, coalesce(last_value(own ignore nulls) over (partition by source_id order by line_no rows between unbounded preceding and current row), 'default') as context from c)"""


def _context(spark, sf):
    key = F.coalesce(F.when(F.col("line").rlike(reorder.RULES[4][1]), F.concat(F.lit("bracket_tag:"), F.regexp_extract("line", reorder.RULES[4][1], 1))), F.when(F.col("line").rlike("user=([0-9]+)"), F.concat(F.lit("user:"), F.regexp_extract("line", "user=([0-9]+)", 1))))
    return reorder.context_keys(log_view(spark, sf), key)


@query("reorder_context", f"with {_CTX} select source_id, line_no, line, context, row_number() over (partition by source_id order by context, line_no) as place from f")
def _reorder(spark, sf):
    return reorder.regroup(_context(spark, sf))


@query("reorder_appearance", f"with {_CTX}, m as (select *, min(line_no) over (partition by source_id, context) as first from f) select source_id, line_no, line, context, row_number() over (partition by source_id order by first, line_no) as place from m")
def _reorder_first(spark, sf):
    return reorder.regroup_by_appearance(_context(spark, sf))


@query("reorder_roles", "select conv_id as source_id, turn as line_no, role as context, row_number() over (partition by conv_id order by role, turn) as place from conversations")
def _reorder_roles(spark, sf):
    conv = ingest.table(spark, sf, "conversations").select(F.col("conv_id").alias("source_id"), F.col("turn").alias("line_no"), F.col("role").alias("context"))
    return reorder.regroup(conv)


# ---- usage analytics -----------------------------------------------------------------------------

_EVENTS = """e as (select e.ts as timestamp, case when event_type = 'view' then null else event_type end as filter_name, cast(floor(value * 100) as bigint) as ib, cast(floor(value * 40) as bigint) as ob, user_id % 50 as filter_time_ms from events e),
t as (select *, ib // 4 as input_tokens, ob // 4 as output_tokens from e)"""
_GAIN = "count(*) as runs, cast(sum(input_tokens) as bigint) as input_tokens, cast(sum(output_tokens) as bigint) as output_tokens, cast(greatest(sum(input_tokens) - sum(output_tokens), 0) as bigint) as saved, round(avg(filter_time_ms), 4) as avg_ms, case when coalesce(sum(input_tokens), 0) = 0 then 0.0 else round(greatest(sum(input_tokens) - sum(output_tokens), 0) * 100.0 / sum(input_tokens), 4) end as saved_pct"


def _usage(spark, sf):
    e = ingest.table(spark, sf, "events")
    return tracking.estimates(e.select(
        F.col("ts").alias("timestamp"), F.when(F.col("event_type") == "view", F.lit(None)).otherwise(F.col("event_type")).alias("filter_name"),
        F.floor(F.col("value") * 100).cast("bigint").alias("input_bytes"), F.floor(F.col("value") * 40).cast("bigint").alias("output_bytes"), (F.col("user_id") % 50).alias("filter_time_ms")))


@query("gain_summary", f"with {_EVENTS} select {_GAIN} from t")
def _gain(spark, sf):
    return tracking.gain(_usage(spark, sf))


@query("gain_daily", f"with {_EVENTS} select cast(cast(timestamp as date) as varchar) as day, {_GAIN} from t where cast(timestamp as date) >= (select max(cast(ts as date)) from events) - 7 group by 1")
def _daily(spark, sf):
    now = str(ingest.table(spark, sf, "events").agg(F.max(F.to_date("ts"))).first()[0])
    return tracking.daily(_usage(spark, sf), now).withColumn("day", F.col("day").cast("string"))


@query("gain_by_filter", f"with {_EVENTS} select coalesce(filter_name, 'passthrough') as filter, {_GAIN} from t group by 1")
def _by_filter(spark, sf):
    return tracking.by_filter(_usage(spark, sf))


@query("gain_retained", "select count(*) as n from events where cast(ts as date) >= (select max(cast(ts as date)) from events) - 10")
def _retained(spark, sf):
    now = str(ingest.table(spark, sf, "events").agg(F.max(F.to_date("ts"))).first()[0])
    return tracking.retained(_usage(spark, sf), now, 10).agg(F.count(F.lit(1)).alias("n"))


@query("price_estimate", f"with {_EVENTS}, g as (select cast(greatest(sum(input_tokens) - sum(output_tokens), 0) as bigint) as saved from t) select model, round(saved * price / 1e6, 6) as usd from g, (values " + ",".join(f"('{m}', {p}::double)" for m, p in tracking.PRICES) + ") p(model, price)")
def _prices(spark, sf):
    return tracking.prices(tracking.gain(_usage(spark, sf)))


_COMMANDS = [("git status", 400), ("git log --oneline", 900), ("textsieve run make", 50), ("cargo test --all", 1200), ("ls -la", 80), ("ls -la /tmp", 30), ("purchase it", 1000), ("FOO=1 npm install", 700)]


@query("discover_groups", f"""with {_EVENTS}, h as (select coalesce(filter_name, 'passthrough') as filter, {_GAIN} from t group by 1), c(class, key, n, o) as (values ('filterable', 'vcs_git', 2, 1300), ('already_filtered', 'textsieve run', 1, 50), ('filterable', 'rust', 1, 1200), ('no_filter', 'ls -la', 2, 110), ('no_filter', 'purchase it', 1, 1000), ('filterable', 'nodejs', 1, 700))
select key, class, n, 0 as input_tokens, o as output_tokens, h.saved_pct as pct, cast(trunc(o * coalesce(h.saved_pct / 100.0, 0.30)) as bigint) as estimated from c left join h on h.filter = c.key""")
def _discover(spark, sf):
    cmds = spark.createDataFrame(_COMMANDS, "command string, output_tokens bigint").withColumn("input_tokens", F.lit(0).cast("bigint"))
    return tracking.discover(tracking.classify(cmds), tracking.by_filter(_usage(spark, sf)))


@query("discover_potential", "select cast(390 + 360 + 33 + 300 + 210 as bigint) as total")
def _potential(spark, sf):
    return tracking.potential(_discover(spark, sf))


@query("command_scalars", "select * from (values (0, 'make all', false, 2), (1, 'x', true, 1), (2, 'git log', false, 3)) t(k, bare, transparent, parts)")
def _commands(spark, sf):
    df = spark.createDataFrame([(0, "A=1 B='x y' make all", "a && b"), (1, "x", "echo 'a;b'"), (2, "git log", "a | b; c")], "k int, c string, l string")
    return df.select("k", tracking.strip_env(F.col("c")).alias("bare"), tracking.is_transparent(F.when(F.col("k") == 1, "sudo ls").otherwise(F.col("c"))).alias("transparent"), F.size(tracking.split_compound(F.col("l"))).alias("parts"))


# ---- streams -------------------------------------------------------------------------------------

@query("stream_equals_batch", "select event_type, count(*) as n from events group by event_type")
def _stream(spark, sf):
    """The events as a stream of micro-batches, summed by the sink."""
    import uuid

    table = f"{(spark.conf.get('spark.checkpoint.dir', None) or '/tmp/textsieve-stream').rstrip('/')}/stream-{uuid.uuid4().hex}"
    source = ingest.table(spark, sf, "events")

    def each(batch: DataFrame, number: int) -> None:
        batch.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{table}/part={number}")

    q = stream.run_batches(spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "events.parquet*").parquet(sf if _is_file(spark, sf) else f"{sf}/events.parquet"), each, f"{table}-checkpoint")
    q.awaitTermination()
    return spark.read.schema("event_type string, n bigint, part int").parquet(table).groupBy("event_type").agg(F.sum("n").alias("n"))


def _is_file(spark: SparkSession, sf: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf}/events.parquet")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isFile()


@query("window_counts", "select date_trunc('day', ts) as start, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2")
def _windows(spark, sf):
    return stream.window_counts(ingest.table(spark, sf, "events")).withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("total", F.round("total", 2))


for _name, (_f, _sql) in (fixtures.QUERIES | derived.QUERIES).items():
    QUERIES[_name] = _f
    if _sql:
        ORACLES[_name] = _sql
