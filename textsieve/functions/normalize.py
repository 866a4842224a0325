"""Scalar normalisations of log lines (NRM-*): Column -> Column.

Patterns spell out ASCII classes, so that Java's and RE2's engines agree.
"""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values.
ANSI = "\x1b\\[[0-9;]*[A-Za-z]"
ADDRESS = "0x[0-9a-fA-F]{8,16}"
BUILD_HASH = "/(?i:derivedData)/[^/]+-[a-z0-9]+/|\\b[0-9a-fA-F]{32,40}\\b"
FLAG_PREFIXES = ("-I", "-L", "-D", "-W", "-f", "-std=", "-O", "-m")
JOINED_FLAGS = ("-I", "-L", "-D", "-isystem", "-F")
NOISE_PREFIXES = ("Generating", "Copying", "Checking", "Installing", "Skiped", "skipping")
STATUS_REASONS = {
    "200": "OK", "201": "Created", "204": "No Content", "301": "Moved Permanently", "302": "Found", "400": "Bad Request", "401": "Unauthorized", "403": "Forbidden", "404": "Not Found",
    "408": "Request Timeout", "429": "Too Many Requests", "500": "Internal Server Error", "502": "Bad Gateway", "503": "Service Unavailable", "504": "Gateway Timeout",
}
STATIC_SUFFIXES = (".js", ".css", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".map", ".woff", ".woff2")
SENSITIVE = (".env", "wp-", "wp/", "admin", "config", "backup", "phpmyadmin", ".git", "passwd", "secret")


def slashes(line: Column) -> Column:
    return F.replace(line, F.lit("\\"), F.lit("/"))


def mask_addresses(line: Column) -> Column:
    return F.regexp_replace(line, ADDRESS, "0x[ADDR]")


def mask_build_hash(line: Column) -> Column:
    return F.regexp_replace(line, BUILD_HASH, "/[HASH]/")


def words(line: Column) -> Column:
    return F.filter(F.split(F.trim(line), "[ \\t]+"), lambda x: x != "")


def sort_flags(line: Column) -> Column:
    """NRM-02: compiler flags after everything else, sorted; ``-I x`` becomes ``-Ix``."""
    w = words(line)
    joins = lambda x: x.isin(*JOINED_FLAGS)
    starts = lambda x: x.rlike("^(-I|-L|-D|-W|-f|-std=|-O|-m)")
    # a value follows a joined flag unless it is itself the joined flag's value; flags are never values of values
    state = F.aggregate(
        w, F.struct(F.array().cast("array<string>").alias("base"), F.array().cast("array<string>").alias("flags"), F.lit("").alias("open")),
        lambda s, x: F.when(s["open"] != "", F.struct(s["base"].alias("base"), F.array_append(s["flags"], F.concat(s["open"], x)).alias("flags"), F.lit("").alias("open")))
        .when(joins(x), F.struct(s["base"].alias("base"), s["flags"].alias("flags"), x.alias("open")))
        .when(starts(x), F.struct(s["base"].alias("base"), F.array_append(s["flags"], x).alias("flags"), F.lit("").alias("open")))
        .otherwise(F.struct(F.array_append(s["base"], x).alias("base"), s["flags"].alias("flags"), F.lit("").alias("open"))),
        lambda s: F.struct(
            F.when((s["open"] != "") & ~starts(s["open"]), F.array_append(s["base"], s["open"])).otherwise(s["base"]).alias("base"),
            F.array_sort(F.when((s["open"] != "") & starts(s["open"]), F.array_append(s["flags"], s["open"])).otherwise(s["flags"])).alias("flags")),
    )
    out = F.concat_ws(" ", state["base"], state["flags"])
    return F.when((F.size(w) < 2) | (F.size(state["flags"]) == 0), line).otherwise(out)


def balanced_json(text: str | None) -> tuple[int, int] | None:
    """NRM-04: where the first balanced object or array that opens with a brace lies; strings and escapes are respected."""
    if not text:
        return None
    start = text.find("{")
    if start < 0:
        return None
    depth, quoted, escaped = 0, False, False
    for i in range(start, len(text)):
        c = text[i]
        if quoted:
            escaped, quoted = (False, True) if escaped else (c == "\\", c != '"')
        elif c == '"':
            quoted = True
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0:
                return start, i + 1
    return None


def all_json(text: str | None) -> list[str]:
    """NRM-05: every balanced object in turn."""
    out, rest = [], text or ""
    while (at := balanced_json(rest)) is not None:
        out.append(rest[at[0]:at[1]])
        rest = rest[at[1]:]
    return out


@F.pandas_udf(T.StringType())
def extract_json(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if (at := balanced_json(t)) is None else t[at[0]:at[1]])


@F.pandas_udf(T.ArrayType(T.StringType()))
def extract_all_json(text: pd.Series) -> pd.Series:
    return text.map(all_json)


def canonical_json(text: Column) -> Column:
    """NRM-03: minified with sorted keys; null where it is no JSON."""
    return F.to_json(F.try_parse_json(text))


def canonical_json_in(line: Column) -> Column:
    """NRM-03 on the first object of a line; other lines stay."""
    own = extract_json(line)
    made = canonical_json(own)
    at = F.position(own, line)
    return F.when(own.isNull() | made.isNull(), line).otherwise(F.concat(F.substring(line, F.lit(1), at - 1), made, F.substring(line, at + F.length(own), F.length(line))))


def normalize_line(line: Column, embedded_json: bool = False) -> Column:
    """NRM-01: slashes, addresses, flags, JSON and build hashes."""
    out = mask_addresses(slashes(line))
    out = F.when(F.contains(out, F.lit(" -")), sort_flags(out)).otherwise(out)
    return mask_build_hash(canonical_json_in(out) if embedded_json else out)


def strip_ansi(line: Column) -> Column:
    """NRM-06."""
    return F.regexp_replace(line, ANSI, "")


def last_redraw(line: Column) -> Column:
    """NRM-07: what stands after the last carriage return."""
    return F.substring_index(line, "\r", -1)


def tidy_blanks(line: Column) -> Column:
    """NRM-08: tabs are blanks; trailing blanks go."""
    return F.regexp_replace(F.replace(line, F.lit("\t"), F.lit(" ")), "[ ]+\\z", "")


def parse_timestamp(text: Column, today: Column | None = None) -> Column:
    """NRM-10: RFC 3339 (Z if no zone is given), milliseconds since 1970, or HH:MM:SS of today."""
    iso = F.try_to_timestamp(F.regexp_extract(text, "([0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\\.[0-9]+)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)", 1))
    digits = F.regexp_extract(text, "(?:^|[^0-9])([0-9]{13})(?:[^0-9]|$)", 1).try_cast("bigint")
    clock = F.regexp_extract(text, "(?:^|[^0-9])([0-9]{2}:[0-9]{2}:[0-9]{2})(?:[^0-9]|$)", 1)
    out = F.coalesce(iso, F.when(digits > 1_000_000_000_000, F.timestamp_millis(digits)))
    return out if today is None else F.coalesce(out, F.try_to_timestamp(F.concat(today.cast("string"), F.lit(" "), clock)))


def bracket_time(line: Column) -> Column:
    """The instant of a leading ``[ISO]``, in milliseconds."""
    return F.unix_millis(F.try_to_timestamp(F.regexp_extract(line, "^\\[([0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:.]+Z?)\\]", 1)))


def pipeline_token(line: Column) -> Column:
    """NRM-11."""
    return F.replace(line, F.lit("[Pipeline]"), F.lit("$PL"))


def sql_skeleton(text: Column) -> Column:
    """NRM-12: literals become ``?``; only texts above 50 bytes."""
    return F.when(F.octet_length(text) > 50, F.regexp_replace(F.regexp_replace(text, "'[^']*'", "'?'"), "\\b[0-9]+\\b", "?")).otherwise(text)


def truncate_values(text: Column, most: int = 100) -> Column:
    """NRM-13: a VALUES list above ``most`` bytes is cut."""
    own = F.regexp_extract(text, "(?is)values\\s*(.*)\\z", 1)
    return F.when(F.octet_length(own) > most, F.concat(F.substring(text, F.lit(1), F.length(text) - F.length(own)), F.substring(own, F.lit(1), F.lit(most)), F.lit("..."))).otherwise(text)


# A word of hex digits; longer ones than a dictionary takes are only counted.
HEX, HEX_DUMP = r"\b[0-9a-fA-F]{32,}\b", 128


def hex_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(HEX), F.lit(0))


def mask_hex(text: Column, tokens: Column | None = None) -> Column:
    """NRM-14: words of more than 128 hex digits become their length; shorter ones, from 32 on, what tokens (a map) has for them."""
    def shown(x: Column) -> Column:
        short = x if tokens is None else F.coalesce(F.element_at(tokens, x), x)
        return F.when(F.length(x) > HEX_DUMP, F.concat(F.lit("[HEX_DUMP: "), F.length(x).cast("string"), F.lit(" chars]"))).otherwise(short)

    between, words = F.split(text, HEX, -1), hex_words(text)
    return F.when(F.size(words) == 0, text).otherwise(F.array_join(F.zip_with(between, words, lambda a, x: F.concat(a, F.coalesce(shown(x), F.lit("")))), ""))


def binary_marker(text: Column) -> Column:
    """NRM-15."""
    return F.concat(F.lit("[BINARY_DATA: Size="), F.octet_length(text).cast("string"), F.lit("B, MD5="), F.substring(F.md5(F.encode(text, "UTF-8")), 1, 8), F.lit("]"))


def url_path(url: Column) -> Column:
    t = F.trim(url)
    own = F.regexp_extract(t, "^https?://[^/]*(/.*)\\z", 1)
    return F.when(t.rlike("^https?://"), F.when(own == "", "/").otherwise(own)).otherwise(t)


def normalize_route(url: Column) -> Column:
    """NRM-16: the path with ids (four digits, or 16 hex digits and dashes) as ``:id``."""
    parts = F.filter(F.split(F.substring_index(url_path(url), "?", 1), "/"), lambda x: x != "")
    return F.concat(F.lit("/"), F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]{4,}$") | p.rlike("^[0-9a-fA-F-]{16,}$"), ":id").otherwise(p)), "/"))


def status_bucket(status: Column) -> Column:
    """NRM-17."""
    return F.when(status.rlike("^[2-5]"), F.concat(F.substring(status, 1, 1), F.lit("xx"))).otherwise("other")


def status_reason(status: Column) -> Column:
    out = F.lit("")
    for code, reason in STATUS_REASONS.items():
        out = F.when(status == code, reason).otherwise(out)
    return out


def is_internal(ip: Column) -> Column:
    octet = F.regexp_extract(ip, "^172\\.([0-9]{1,3})(?:\\.|$)", 1).try_cast("int")
    return ip.isin("127.0.0.1", "::1") | ip.rlike("^(10\\.|192\\.168\\.|fc|fd)") | F.coalesce(octet.between(16, 31), F.lit(False))


def ip_class(ip: Column) -> Column:
    """NRM-18."""
    return (
        F.when((ip == "-") | (ip == ""), "Unknown").when(is_internal(ip), "Internal").when(ip.startswith("203.0.113."), "Documentation/Scanner")
        .when(ip.startswith("198.51.100."), "Documentation/Edge").otherwise("External")
    )


def agent_class(ua: Column) -> Column:
    """NRM-19."""
    low = F.lower(ua)
    return (
        F.when((low == "-") | (low == ""), "Unknown").when(F.contains(low, F.lit("kube-probe")), "Health/Kubernetes").when(F.contains(low, F.lit("elb-healthchecker")), "Health/ALB")
        .when(F.contains(low, F.lit("googlebot")), "Bot/Google").when(F.contains(low, F.lit("bingbot")), "Bot/Bing")
        .when(low.rlike("python-requests|curl/|wget/|go-http-client"), "Bot/Script").when(F.contains(low, F.lit("mozilla/")), "Browser").otherwise("Other")
    )


def agent_token(ua: Column) -> Column:
    low = F.lower(ua)
    return (
        F.when(F.contains(low, F.lit("kube-probe")), "$UA_KUBE").when(F.contains(low, F.lit("elb-healthchecker")), "$UA_ELB").when(F.contains(low, F.lit("googlebot")), "$UA_BOT_GOOGLE")
        .when(F.contains(low, F.lit("bingbot")), "$UA_BOT_BING").when(F.contains(low, F.lit("python-requests")), "$UA_REQ").when(low.rlike("curl/|wget/"), "$UA_CLI")
        .when(F.contains(low, F.lit("mozilla/")), "$UA_BROWSER").otherwise("$UA")
    )


def _any(names: tuple[str, ...]) -> str:
    return "(" + "|".join(x.replace(".", "\\.") for x in names) + ")"


def is_health(route: Column, ua: Column) -> Column:
    """NRM-20."""
    r = F.lower(route)
    return r.rlike("/health|/ready|/live") | (r == "/ping") | F.lower(ua).rlike("kube-probe|elb-healthchecker")


def is_static(route: Column) -> Column:
    return F.lower(route).rlike(_any(STATIC_SUFFIXES) + "$")


def is_sensitive(route: Column) -> Column:
    return F.lower(route).rlike(_any(SENSITIVE))


def routine_kind(route: Column, ua: Column) -> Column:
    return F.when(is_health(route, ua), "health").when(is_static(route), "static").when(agent_class(ua).startswith("Bot/"), "bot").otherwise("routine")


def duration_ms(value: Column, unit: Column | None = None) -> Column:
    """NRM-21: seconds (``0.2``, ``0.2s``) or milliseconds (``200ms``) as whole milliseconds."""
    n = F.regexp_extract(value, "^\"?([0-9]+(?:\\.[0-9]+)?)", 1).try_cast("double")
    return F.round(F.when(value.rlike("[0-9]ms\"?$"), n).otherwise(n * 1000)).cast("bigint")


def compact_spaces(value: Column) -> Column:
    """NRM-22."""
    return F.trim(F.regexp_replace(value, "[ \\t\\r\\n]+", " "))


def trim_to(value: Column, most: int) -> Column:
    """NRM-23: values above ``most`` bytes are cut to as many, with an ellipsis; a character that the cut would part goes."""
    head = F.make_valid_utf8(F.substring(F.encode(value, "UTF-8"), 1, most).cast("string"))
    return F.when(F.octet_length(value) > most, F.concat(F.regexp_replace(head, "\\x{FFFD}\\z", ""), F.lit("..."))).otherwise(value)


def compact_time(value: Column) -> Column:
    """NRM-24: ``dateTtime.fraction+zone`` -> ``date time``."""
    t = F.regexp_replace(F.trim(value), "^\"+|\"+$", "")
    time = F.regexp_extract(t, "^[^T]*T([^.+Z]*)", 1)
    plain = F.replace(F.replace(F.replace(t, F.lit(" +0000"), F.lit("")), F.lit(" +0800"), F.lit("")), F.lit(" UTC"), F.lit(""))
    return F.when(time != "", F.concat(F.substring_index(t, "T", 1), F.lit(" "), time)).otherwise(plain)


def compact_stream(value: Column) -> Column:
    p = F.split(value, "/")
    return F.when(F.size(p) >= 3, F.concat_ws("/", p[0], p[1], F.substring(F.element_at(p, -1), 1, 8))).otherwise(value)


def minify_tags(text: Column) -> Column:
    """NRM-25."""
    return F.regexp_replace(text, ">[ \\t\\r\\n]+<", "><")


def strip_tags(text: Column) -> Column:
    """NRM-26."""
    return F.regexp_replace(text, "<[^>]*>", "")


def strip_comments(text: Column) -> Column:
    """NRM-27."""
    return F.regexp_replace(text, "(?s)<!--.*?-->", "")


# NRM-28: what differs between two runs of the same tool.
VOLATILE = {
    "container": ("\\b[0-9a-f]{12,64}\\b", "[CID]"),
    "ip": ("\\b[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\b", "[IP]"),
    "query": ("\\?[^ )\"']*", ""),
    "thread": ("\\[(?:nio|http|exec|main|pool)[^\\]]*\\]", "[thread]"),
    "user_dir": ("(?:/Users/|/home/)[^/ ]+", "~"),
    "progress": ("[0-9]{1,3}%", "[%]"),
}


def mask_volatile(line: Column, kinds: tuple[str, ...] = tuple(VOLATILE)) -> Column:
    for k in kinds:
        line = F.regexp_replace(line, *VOLATILE[k])
    return line


def human_count(n: Column) -> Column:
    """NRM-29: 999, 1.2K, 3.4M."""
    return F.when(n >= 1_000_000, F.concat(F.format_number(n / 1_000_000, 1), F.lit("M"))).when(n >= 1_000, F.concat(F.format_number(n / 1_000, 1), F.lit("K"))).otherwise(n.cast("string"))


def thousands(n: Column) -> Column:
    """NRM-29: 1,234."""
    return F.format_number(n, 0)


def human_bytes(n: Column) -> Column:
    """NRM-29: 12 B, 1.50 KB, 2.00 MB, 3.25 GB."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB"), 1):
        out = F.when(n >= 1024 ** k, F.concat(F.format_string("%.2f", F.bround(n / 1024.0 ** k, 2)), F.lit(f" {unit}"))).otherwise(out)
    return out


def apply_patch(base: Column, patch: Column) -> Column:
    """NRM-30: ``i:old->new,...`` on the words of base (from 0); an entry whose old word is not there is ignored."""
    edits = F.filter(F.split(patch, ","), lambda e: e.rlike("^[0-9]+:.*->"))
    return F.array_join(F.aggregate(
        edits, F.split(base, " +"),
        lambda w, e: F.transform(w, lambda x, i: F.when((i == F.substring_index(e, ":", 1).cast("int")) & (x == F.regexp_extract(e, "^[0-9]+:(.*?)->", 1)), F.regexp_extract(e, "->(.*)$", 1)).otherwise(x))), " ")
