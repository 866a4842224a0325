"""Web access analytics (WEB-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize as N
from .reorder import top_counts

# Patterns of access lines and what their groups are.
IP, NUM = r"([0-9a-fA-F:.]+)", r"([0-9]+|-)"
PATTERNS = {
    "combined": (rf'^{IP}[ \t]+([^ \t]+)[ \t]+([^ \t]+)[ \t]+\[([^\]]+)\][ \t]+"([A-Z]+)[ \t]+([^ \t]+)[ \t]+([^"]+)"[ \t]+([0-9]{{3}})[ \t]+{NUM}[ \t]+"([^"]*)"[ \t]+"([^"]*)"(?:[ \t]+(.*))?$',
                 {"ip": 1, "time": 4, "method": 5, "path": 6, "status": 8, "bytes": 9, "referer": 10, "ua": 11, "tail": 12}),
    "common": (rf'^{IP}[ \t]+([^ \t]+)[ \t]+([^ \t]+)[ \t]+\[([^\]]+)\][ \t]+"([A-Z]+)[ \t]+([^ \t]+)[ \t]+([^"]+)"[ \t]+([0-9]{{3}})[ \t]+{NUM}(?:[ \t]+(.*))?$',
               {"ip": 1, "time": 4, "method": 5, "path": 6, "status": 8, "bytes": 9, "tail": 10}),
    "uvicorn": (rf'^([A-Z]+):[ \t]+{IP}:[0-9]+[ \t]+-[ \t]+"([A-Z]+)[ \t]+([^ \t"]+)[ \t]+HTTP/[0-9.]+"[ \t]+([0-9]{{3}})[ \t]+(.*)$', {"ip": 2, "method": 3, "path": 4, "status": 5, "reason": 6}),
    "Envoy": (r'^\[([^\]]+)\][ \t]+"([A-Z]+)[ \t]+([^ \t"]+)[ \t]+HTTP/[0-9.]+"[ \t]+([0-9]{3})[ \t]+([^ \t]+)[ \t]+([0-9]+|-)[ \t]+([0-9]+|-)[ \t]+([0-9]+|-)[ \t]+[^ \t]+[ \t]+"([^"]*)"[ \t]+"([^"]*)".*$',
              {"time": 1, "method": 2, "path": 3, "status": 4, "bytes": 7, "ms": 8, "ip": 9, "ua": 10}),
    "ALB": (rf'^(?:http|https|h2|ws|wss|grpcs)[ \t]+([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[^ \t]+)[ \t]+[^ \t]+[ \t]+{IP}:[0-9]+[ \t]+[^ \t]+[ \t]+(-?[0-9.]+)[ \t]+(-?[0-9.]+)[ \t]+(-?[0-9.]+)[ \t]+([0-9]{{3}}|-)[ \t]+([0-9]{{3}}|-)[ \t]+{NUM}[ \t]+{NUM}[ \t]+"([A-Z]+)[ \t]+([^ \t"]+)[ \t]+HTTP/[0-9.]+"[ \t]+"([^"]*)".*$',
            {"time": 1, "ip": 2, "seconds": 4, "status": 6, "bytes": 9, "method": 10, "path": 11, "ua": 12}),
}
#: What wraps an access line, as (source, pattern of time, stream and message): a tailed log stream, a row of a table.
TAIL = r"^([0-9]{4}-[0-9]{2}-[0-9]{2}T[^ \t]+)[ \t]+([^ \t]+)[ \t]+(.+)$"
TABLE_ROW = r"^\|[ \t]*([0-9]{10,}|[0-9]{4}-[0-9]{2}-[0-9]{2}T[^|]+?)[ \t]*\|[ \t]*(.*?)[ \t]*\|$"
ERROR = r"^([0-9]{4}/[0-9]{2}/[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2})[ \t]+\[([a-z]+)\][ \t]+([0-9]+)#[0-9]+:[ \t]+\*[0-9]+[ \t]+(.*)$"
FIELDS = ("source", "time", "ip", "method", "path", "status", "bytes", "referer", "ua", "reason")


def wrapper(line: Column) -> Column:
    """struct(source, time, message) of a wrapped line, else null."""
    get = lambda p, g: F.regexp_extract(line, p, g)
    made = lambda source, time, message: F.struct(source.alias("source"), N.compact_time(time).alias("time"), message.alias("message"))
    return F.when(line.rlike(TAIL), made(F.concat(F.lit("AWS:"), N.compact_stream(get(TAIL, 2))), get(TAIL, 1), get(TAIL, 3))).when(
        line.rlike(TABLE_ROW), made(F.lit("CLOUD_TABLE"), get(TABLE_ROW, 1), get(TABLE_ROW, 2)))


def errors(lines: DataFrame) -> DataFrame:
    """PLG-01: error lines of a server: (source_id, line_no, time, level, pid, msg, text)."""
    at = lambda g: F.regexp_extract("line", ERROR, g)
    out = lines.where(F.col("line").rlike(ERROR)).select("source_id", "line_no", at(1).alias("time"), at(2).alias("level"), at(3).alias("pid"), at(4).alias("msg"))
    return out.withColumn("text", F.concat_ws("|", F.lit("$W|E"), "time", "level", "msg"))


def parse(lines: DataFrame) -> DataFrame:
    """WEB-01: access records of lines of any known form, plain or wrapped; other lines go. JSON records are read by their usual names.

    A wrapper's time goes before the line's own; its source is that of forms that name none."""
    # what a generator gives cannot be copied into each of its uses
    lines = lines.select("*", F.explode(F.array(wrapper(F.trim("line")))).alias("_w")).select("*", F.explode(F.array(F.coalesce("_w.message", "line"))).alias("_m"))
    line = F.col("_m")
    recs = []
    for name, (p, groups) in PATTERNS.items():
        get = lambda k, p=p, groups=groups: F.regexp_extract(line, p, groups[k]) if k in groups else F.lit("")
        dash = lambda c: F.when(c == "", "-").otherwise(c)
        ms = get("ms").try_cast("bigint") if "ms" in groups else N.duration_ms(get("seconds")) if "seconds" in groups else N.duration_ms(F.regexp_extract(get("tail"), r"([0-9]+\.[0-9]+)$", 1)) if "tail" in groups else F.lit(None).cast("bigint")
        recs.append(F.when(line.rlike(p), F.struct(
            F.lit(name).alias("source"), *[(get(k) if k in ("method", "path", "status", "reason") else dash(get(k))).alias(k) for k in FIELDS[1:]], ms.alias("duration_ms"))))
    j = lambda *names: F.coalesce(*[F.get_json_object(line, f"$.{n}") for n in names], F.lit("-"))
    recs.append(F.when(line.rlike(r"^\s*\{.*\}\s*$") & F.get_json_object(line, "$.status").isNotNull(), F.struct(
        F.lit("json").alias("source"), j("time", "timestamp", "ts").alias("time"), j("remote_addr", "ip", "client_ip").alias("ip"), j("method", "request_method").alias("method"), j("path", "uri", "request_uri", "url").alias("path"),
        j("status").alias("status"), j("bytes", "body_bytes_sent").alias("bytes"), j("referer", "http_referer").alias("referer"), j("ua", "user_agent", "http_user_agent").alias("ua"), F.lit("").alias("reason"),
        N.duration_ms(j("request_time", "duration")).alias("duration_ms"))))
    out = lines.select("*", F.explode(F.filter(F.array(F.coalesce(*recs)), lambda r: r.isNotNull())).alias("_rec"))
    own = F.struct(
        F.when(F.col("_w").isNotNull() & F.col("_rec.source").isin("combined", "common", "uvicorn"), F.col("_w.source")).otherwise(F.col("_rec.source")).alias("source"),
        F.coalesce("_w.time", "_rec.time").alias("time"), *[F.col(f"_rec.{k}").alias(k) for k in (*FIELDS[2:], "duration_ms")])
    return out.select("source_id", "line_no", F.explode(F.array(own)).alias("_rec"), "line").select("source_id", "line_no", "_rec.*", F.col("line").alias("raw")).withColumn("reason", F.when(F.col("reason") == "", N.status_reason(F.col("status"))).otherwise(F.col("reason")))


def parse_delimited(lines: DataFrame, sep: str = " ") -> DataFrame:
    """WEB-01: header-driven forms (``#Fields:`` of W3C, or a CSV header): the header of each source names its columns."""
    head = lines.where(F.col("line").startswith("#Fields:")).groupBy("source_id").agg(F.split(F.regexp_replace(F.min_by("line", "line_no"), "^#Fields: *", ""), " ").alias("_h")) if sep == " " else lines.where("line_no = 1").select("source_id", F.split("line", sep).alias("_h"))
    rows = lines.where(~F.col("line").startswith("#") & ((F.col("line_no") > 1) if sep != " " else F.lit(True))).join(head, "source_id")
    m = F.map_from_entries(F.filter(F.arrays_zip(F.col("_h").alias("k"), F.split("line", "[" + sep + "]").alias("v")), lambda e: e["k"].isNotNull() & e["v"].isNotNull()))
    pick = lambda *names: F.coalesce(*[F.element_at("_m", F.lit(n)) for n in names], F.lit("-"))
    return rows.withColumn("_m", m).select(
        "source_id", "line_no", F.lit("IIS_W3C" if sep == " " else "csv").alias("source"), F.concat_ws(" ", pick("date"), pick("time")).alias("time"), pick("c-ip", "ip", "client_ip").alias("ip"), pick("cs-method", "method").alias("method"),
        pick("cs-uri-stem", "path", "url").alias("path"), pick("sc-status", "status").alias("status"), pick("sc-bytes", "bytes").alias("bytes"), pick("cs(Referer)", "referer").alias("referer"), pick("cs(User-Agent)", "user_agent").alias("ua"),
        N.duration_ms(F.concat(pick("time-taken", "duration"), F.lit("ms"))).alias("duration_ms"))


def with_route(records: DataFrame) -> DataFrame:
    return records.withColumn("route", N.normalize_route(F.col("path"))).withColumn("bucket", N.status_bucket(F.col("status"))).withColumn("kind", N.routine_kind(F.col("route"), F.col("ua")))


def summary(records: DataFrame) -> DataFrame:
    """WEB-02: one row."""
    r = with_route(records)
    return r.agg(
        F.count(F.lit(1)).alias("records"), F.min_by("time", "line_no").alias("first_time"), F.max_by("time", "line_no").alias("last_time"),
        *[F.count_if(F.col("bucket") == b).alias("n_" + b) for b in ("2xx", "3xx", "4xx", "5xx", "other")],
        F.countDistinct("ip").alias("ips"), F.countDistinct("route").alias("urls"), F.countDistinct("ua").alias("uas"), F.coalesce(F.sum(F.col("bytes").try_cast("bigint")), F.lit(0)).alias("bytes_total"))


TOPS = {"status": 8, "method": 6, "source": 4, "url": 8, "ip": 8, "ua": 6, "referer": 6}


def tops(records: DataFrame) -> DataFrame:
    """WEB-03: (dimension, value, n): the most frequent values of every dimension, from one pass."""
    r = with_route(records)
    dims = F.array(
        *[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in ("status", "method", "source", "ip", "ua")],
        F.struct(F.lit("url").alias("dimension"), F.concat_ws(" ", "method", "route").alias("value")),
        F.struct(F.lit("referer").alias("dimension"), F.when(F.col("referer").isin("-", ""), F.lit(None)).otherwise(F.col("referer")).alias("value")))
    long = r.select(F.explode(dims).alias("d")).select("d.*").where("value is not null")
    limit = F.create_map(*[x for k, v in TOPS.items() for x in (F.lit(k), F.lit(v))])
    counts = long.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("_r", F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("n"), "value"))).where(F.col("_r") <= limit[F.col("dimension")]).select("dimension", N.trim_to(F.col("value"), 80).alias("value"), "n")


def is_plain_health(records: DataFrame) -> DataFrame:
    """WEB-04: whether the compact form is due: no 4xx or 5xx, nothing slow, one route."""
    r = with_route(records)
    return r.agg((F.count_if(F.col("bucket").isin("4xx", "5xx") | (F.coalesce("duration_ms", F.lit(0)) >= 1000)) == 0).alias("quiet"), (F.countDistinct("route") == 1).alias("single")).select((F.col("quiet") & F.col("single")).alias("compact"))


def anomalies(records: DataFrame, top: int = 8, top_ips: int = 5) -> DataFrame:
    """WEB-05: (anomaly, hits, ips, sample)."""
    r = with_route(records).where(F.col("status").rlike("^[45]")).withColumn("anomaly", F.concat_ws(" ", "status", "method", "route"))
    groups = r.groupBy("anomaly").agg(F.count(F.lit(1)).alias("hits"), F.min_by(F.col("path"), "line_no").alias("sample")).orderBy(F.desc("hits"), "anomaly").limit(top)
    ips = top_counts(r.join(groups.select("anomaly"), "anomaly", "left_semi"), "ip", top_ips, ["anomaly"])
    listed = ips.groupBy("anomaly").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "ip", "n"))), lambda x: F.concat(x["ip"], F.lit(":"), x["n"].cast("string"))), ",").alias("ips"))
    return groups.join(listed, "anomaly").select("anomaly", "hits", "ips", "sample")


def slow(records: DataFrame, ms: int = 1000, top: int = 5) -> DataFrame:
    """WEB-06."""
    return with_route(records).where(F.col("duration_ms") >= ms).orderBy(F.desc("duration_ms"), "line_no").limit(top).select("line_no", "method", "route", "status", "duration_ms", "ip", N.trim_to(F.col("ua"), 60).alias("ua"))


def routines(records: DataFrame, top: int = 8) -> DataFrame:
    """WEB-07."""
    r = with_route(records).where(~F.col("status").rlike("^[45]"))
    g = r.groupBy("kind", "status", "method", "route").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("ip").alias("ips"), F.countDistinct("ua").alias("uas"), F.floor(F.sum("duration_ms") / F.count("duration_ms")).cast("bigint").alias("avg_ms"))
    return g.where("n >= 2 or kind <> 'routine'").orderBy(F.desc("n"), "kind", "route", "status", "method").limit(top)


def scans(records: DataFrame, top: int = 5) -> DataFrame:
    """WEB-08."""
    r = with_route(records).where(F.col("status").isin("403", "404"))
    g = r.groupBy("ip", "ua").agg(F.count(F.lit(1)).alias("targets"), F.countDistinct("route").alias("routes"), F.count_if(N.is_sensitive(F.col("route"))).alias("sensitive"), F.min_by("time", "line_no").alias("first_time"), F.max_by("time", "line_no").alias("last_time"))
    return g.where("targets >= 5 and (routes >= 4 or sensitive >= 2)").orderBy(F.concat_ws("|", "ip", "ua")).limit(top)


def bursts(records: DataFrame, top: int = 5) -> DataFrame:
    """WEB-09."""
    r = with_route(records).where(F.col("status").startswith("5"))
    g = r.groupBy("status", "method", "route").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ip").alias("ips"), F.min_by("time", "line_no").alias("first_time"), F.max_by("time", "line_no").alias("last_time"))
    return g.where("n >= 3").orderBy(F.concat_ws("|", "status", "method", "route")).limit(top)


def diagnosis(records: DataFrame, least: int = 24) -> DataFrame:
    """WEB-10: one row from ``least`` records on."""
    r = with_route(records)
    a = r.agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("bucket") == "4xx").alias("n_4xx"), F.count_if(F.col("bucket") == "5xx").alias("n_5xx"), F.count_if(F.col("kind") == "health").alias("health"), F.count_if(F.col("kind") == "static").alias("static"), F.count_if(F.col("kind") == "bot").alias("bot"))
    return a.where(F.col("records") >= least).withColumn("err_rate", F.round((F.col("n_4xx") + F.col("n_5xx")) * 100.0 / F.col("records"), 1))


def agent_tokens(records: DataFrame, top: int = 10) -> DataFrame:
    """WEB-11: (ua, n, token); a base token that was given gets its place as suffix."""
    counts = top_counts(records, "ua", top).withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "ua")))  # ten rows
    base = counts.withColumn("base", N.agent_token(F.col("ua")))
    return base.withColumn("k", F.row_number().over(Window.partitionBy("base").orderBy("place"))).select("ua", "n", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat("base", F.col("place").cast("string"))).alias("token"))


def ip_tokens(records: DataFrame, top: int = 10) -> DataFrame:
    """WEB-11: the first scanner is ``$IP_ATK``, the most frequent others ``$IP1..``."""
    attack = scans(records, 1).select("ip", F.lit(True).alias("atk"))
    counts = top_counts(records, "ip", top).join(attack, "ip", "left")
    place = F.sum(F.when(F.col("atk").isNull(), 1).otherwise(0)).over(Window.orderBy(F.desc("n"), "ip"))
    return counts.withColumn("place", place).select("ip", "n", F.when(F.col("atk"), "$IP_ATK").otherwise(F.concat(F.lit("$IP"), F.col("place").cast("string"))).alias("token"))


def choose_form(raw: Column, aggregate: Column, per_line: Column) -> Column:
    """WEB-12: the shorter of both forms, and the raw text if neither is shorter."""
    best = F.when(F.octet_length(aggregate) <= F.octet_length(per_line), aggregate).otherwise(per_line)
    return F.when(F.octet_length(best) < F.octet_length(raw), best).otherwise(raw)
