"""Classification and routing (CLS-*, RTE-*). Confidences are doubles; ties go by rule or registration order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import is_quick_skip
from .slicing import framework_type

# Fixed values: (name, pattern, type, weight).
RULES = (
    ("stack_trace_python", r"(?m)^Traceback \(most recent call last\):", "StackTrace", 0.95),
    ("stack_trace_java", r"(?m)^[ \t]*at[ \t]+[A-Za-z0-9_$.]+\([A-Za-z0-9_$.]+:[0-9]+\)", "StackTrace", 0.9),
    ("stack_trace_node", r"(?m)^[ \t]*at[ \t]+.+\(.+:[0-9]+:[0-9]+\)", "StackTrace", 0.85),
    ("json_object_or_array", r"(?s)^[ \t\r\n]*(\{.*\}|\[.*\])[ \t\r\n]*$", "JsonBlock", 0.85),
    ("xml_or_html_tag", r"(?s)<[A-Za-z][^>]*>.*</[A-Za-z][^>]*>|<\?xml", "XmlBlock", 0.8),
    ("log_header_timestamp", r"(?m)^\[?[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}", "LogBlock", 0.75),
    ("code_keywords", r"\b(fn|class|def|function|public|private|return|if|for|while)\b", "CodeBlock", 0.6),
    ("sql_keywords", r"(?i)\b(select|insert|update|delete|from|where|join)\b", "SqlBlock", 0.7),
)
TYPES = ("StackTrace", "JsonBlock", "XmlBlock", "LogBlock", "CodeBlock", "SqlBlock")
THRESHOLD = 0.5
EXTENSIONS = {
    "CodeBlock": "java jsp groovy gradle kt kts py pyw js jsx ts tsx c cpp h hpp cs csx rs go sh bash zsh scala sbt yaml yml ini cfg conf properties toml",
    "JsonBlock": "json jsonc", "XmlBlock": "xml config", "VueComponent": "vue", "SvelteComponent": "svelte", "HandlebarsTemplate": "hbs handlebars", "ERBTemplate": "erb", "FreemarkerTemplate": "ftl",
    "HtmlBlock": "html htm", "Paragraph": "md markdown", "LogBlock": "txt log",
}
VOCABULARY = {
    "windows_path": r"^[A-Za-z]:\\[^\\]*", "unix_path": r"^/[^/]+/", "java_package": r"^[a-z][a-z0-9_]*(\.[a-z][a-z0-9_]*)+", "maven_coord": r"^[a-z][a-z0-9_]*:[a-z][a-z0-9_-]*:[0-9]",
    "macro_ref": r"\$[A-Z_][A-Z0-9_]*", "gradle_path": r"^:[a-z][a-z0-9_-]*(:[a-z][a-z0-9_-]*)*",
}
SCRIPTS = {
    "Chinese": r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2EBEF}]", "Hiragana": r"[\x{3040}-\x{309F}]", "Katakana": r"[\x{30A0}-\x{30FF}\x{31F0}-\x{31FF}]",
    "Hangul": r"[\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{A960}-\x{A97F}]", "Korean": r"[\x{AC00}-\x{D7AF}]", "Hanja": r"[\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}]",
    "Cyrillic": r"[\x{0400}-\x{052F}\x{2DE0}-\x{2DFF}\x{A640}-\x{A69F}]", "Arabic": r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]",
    "Hebrew": r"[\x{0590}-\x{05FF}\x{FB00}-\x{FB4F}]", "Greek": r"[\x{0370}-\x{03FF}\x{1F00}-\x{1FFF}]", "Thai": r"[\x{0E00}-\x{0E7F}]", "Devanagari": r"[\x{0900}-\x{097F}\x{A8E0}-\x{A8FF}]",
}
ENCODING_SCRIPTS = {
    "utf-8": ("Latin", "Chinese", "Japanese", "Korean"), "gbk": ("Chinese",), "gb2312": ("Chinese",), "big5": ("Chinese", "Hanja"), "shift_jis": ("Japanese", "Katakana", "Hiragana"),
    "euc-kr": ("Korean", "Hangul"), "windows-1251": ("Cyrillic",), "koi8-r": ("Cyrillic",), "windows-1256": ("Arabic",), "windows-1255": ("Hebrew",), "windows-1252": ("Latin",), "latin1": ("Latin",),
}


def check_rules(rules) -> None:
    """CLS-06."""
    if any(r[3] < 0 for r in rules):
        raise ValueError("a rule's weight is negative")


def analyze(text: Column, rules=RULES, terms: Column | None = None) -> Column:
    """CLS-01: struct(slice_type, confidence): the type with the largest sum of weights, plus up to 0.2 for length; below 0.5 Unknown with 0."""
    check_rules(rules)
    types = list(dict.fromkeys(r[2] for r in rules))
    bonus = F.least(F.octet_length(text) / 1000.0, F.lit(1.0)) * 0.2
    scores = []
    for i, t in enumerate(types):
        total = F.lit(0.0)
        for _, p, kind, w in rules:
            if kind == t:
                total = total + F.when(text.rlike(p), F.lit(float(w))).otherwise(0.0)
        if t == "CodeBlock" and terms is not None:
            total = total + F.when(terms, 0.5).otherwise(0.0)
        scores.append(F.struct(F.when(total > 0, total + bonus).otherwise(0.0).alias("score"), F.lit(-i).alias("order"), F.lit(t).alias("type")))
    best = F.array_max(F.array(*scores))
    confidence = F.round(F.least(best["score"], F.lit(1.0)), 6)
    ok = confidence >= THRESHOLD
    return F.struct(F.when(ok, best["type"]).otherwise("Unknown").alias("slice_type"), F.when(ok, confidence).otherwise(0.0).alias("confidence"))


def by_extension(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    out = F.lit(None).cast("string")
    for kind, names in EXTENSIONS.items():
        out = F.when(ext.isin(*names.split()), kind).otherwise(out)
    return out


def quick(path: Column, text: Column, known: Column) -> Column:
    """CLS-02: extension 0.9, known term 0.8, framework 0.7, else Unknown 0.3."""
    ext, fw = by_extension(path), framework_type(text)
    return F.struct(
        F.coalesce(ext, F.when(known, "CodeBlock"), fw, F.lit("Unknown")).alias("slice_type"),
        F.when(ext.isNotNull(), 0.9).when(known, 0.8).when(fw.isNotNull(), 0.7).otherwise(0.3).alias("confidence"),
    )


def vocabulary_category(term: Column) -> Column:
    """CLS-03: the first category whose pattern a term fits."""
    out = F.lit(None).cast("string")
    for name, p in reversed(VOCABULARY.items()):
        out = F.when(term.rlike(p), name).otherwise(out)
    return out


def known_terms(df: DataFrame, text: str, terms: DataFrame) -> DataFrame:
    """CLS-03: rows whose words are known terms (term, category): an equi-join on words; the planner broadcasts a small list."""
    words = df.withColumn("term", F.explode(F.array_distinct(F.split(F.col(text), r"[ \t\n]+"))))
    return words.join(terms, "term").drop("term").distinct()


def scripts(text: Column) -> Column:
    """CLS-04: struct(primary_script, confidence, mixed); what lies in no range is Latin."""
    counts = {name: F.regexp_count(text, F.lit(p)) for name, p in SCRIPTS.items()}
    total = F.length(text)
    others = F.lit(0)
    for c in counts.values():
        others = others + c
    all_ = F.array(F.struct((total - others).alias("n"), F.lit(0).alias("o"), F.lit("Latin").alias("script")), *[F.struct(c.alias("n"), F.lit(-i - 1).alias("o"), F.lit(name).alias("script")) for i, (name, c) in enumerate(counts.items())])
    top = F.array_max(all_)
    return F.struct(
        F.when(total == 0, "Unknown").otherwise(top["script"]).alias("primary_script"),
        F.when(total == 0, 0.0).otherwise(F.round(top["n"] / total, 6)).alias("confidence"),
        (F.coalesce(top["n"], F.lit(0)) < F.floor(total / 2)).alias("mixed"),
    )


def scripts_with_encoding(text: Column, encoding: Column) -> Column:
    """CLS-05: the content's script above 0.7, else the encoding's first with 0.8."""
    own = scripts(text)
    first = F.lit("Unknown")
    for name, s in ENCODING_SCRIPTS.items():
        first = F.when(F.lower(encoding) == name, s[0]).otherwise(first)
    sure = own["confidence"] > 0.7
    return F.struct(F.when(sure, own["primary_script"]).otherwise(first).alias("primary_script"), F.when(sure, own["confidence"]).otherwise(0.8).alias("confidence"), own["mixed"].alias("mixed"))


@dataclass(frozen=True)
class Format:
    """UDX-01: a registered format: its place in the registration, and how a text's confidence is found."""

    name: str
    order: int
    detect: object  # Column -> Column (double)


def detections(text: Column, formats: list[Format], exclude: tuple[str, ...] = ()) -> Column:
    """RTE-01: array of (confidence, -order, name) of all formats."""
    return F.array(*[F.struct(f.detect(text).cast("double").alias("confidence"), F.lit(-f.order).alias("rank"), F.lit(f.name).alias("plugin")) for f in formats if f.name not in exclude])


def route(df: DataFrame, text: str, formats: list[Format], exclude: tuple[str, ...] = ()) -> DataFrame:
    """RTE-02: plugin, confidence, parse_tier and parse_reason: quick skip, else the best format above 0.1."""
    t = F.col(text)
    best = F.array_max(F.filter(F.col("_d"), lambda d: d["confidence"] > 0.1))
    skip = is_quick_skip(t)
    return df.withColumn("_d", detections(t, formats, exclude)).withColumn("_best", F.when(~skip, best)).withColumns({
        "plugin": F.coalesce("_best.plugin", F.lit("none")), "confidence": F.coalesce("_best.confidence", F.lit(0.0)),
        "parse_tier": F.when(F.col("_best").isNotNull(), "full").otherwise("passthrough"),
        "parse_reason": F.when(skip, "quick_skip").when(F.col("_best").isNull(), "no_candidate").otherwise("matched"),
    }).drop("_d", "_best")


def ranking(df: DataFrame, key: str, text: str, formats: list[Format], top: int = 3) -> DataFrame:
    """RTE-07: the best formats of each text, with the gap to the one before."""
    ordered = F.slice(F.reverse(F.array_sort(F.filter(detections(F.col(text), formats), lambda d: d["confidence"] > 0.1))), 1, top)
    out = df.withColumn("_o", ordered)
    return out.select(key, F.posexplode("_o").alias("place", "d"), "_o").select(
        key, (F.col("place") + 1).alias("place"), "d.plugin", "d.confidence", F.round(F.get("_o", F.lit(0))["confidence"] - F.col("d.confidence"), 6).alias("gap"))


def match_share(text: Column, patterns: list[str], least: float = 0.15) -> Column:
    """RTE-05: more than ``least`` of the first 20 lines fit a pattern."""
    head = F.slice(F.split(text, "\n", 21), 1, 20)
    return F.size(F.filter(head, lambda x: x.rlike("|".join(f"(?:{p})" for p in patterns)))) / F.size(head) > least


def command_route(command: Column, routes: list[tuple[str, str, int]], fallback: str = "generic_text") -> Column:
    """RTE-06: (pattern, plugin, priority): the highest priority whose pattern the command fits."""
    out = F.lit(fallback)
    for p, plugin, _ in sorted(routes, key=lambda r: r[2]):
        out = F.when(command.rlike(p), plugin).otherwise(out)
    return out


def npm_test_variant(command: Column, output: Column) -> Column:
    """RTE-08."""
    both = F.concat_ws("\n", command, output)
    return F.when(both.rlike("(?i)vitest"), "vitest").when(both.rlike("(?i)jest|Tests:.*total"), "jest").when(both.rlike("(?i)mocha|passing \\("), "mocha").when(both.rlike("(?i)\\bava\\b"), "ava").otherwise("npm_test")


def unwrap(text: Column, patterns: list[tuple[str, int]], rounds: int = 5) -> Column:
    """RTE-04: wrappers are taken off, the first that fits in each round."""
    for _ in range(rounds):
        inner = F.coalesce(*[F.when(text.rlike(p), F.regexp_extract(text, p, g)) for p, g in patterns])
        text = F.coalesce(inner, text)
    return text


def chain(df: DataFrame, step, following: dict, depth: int = 5) -> DataFrame:
    """RTE-03: a step (DataFrame -> DataFrame), then the step that follows it, until none does or depth is reached."""
    for _ in range(depth):
        if step is None:
            break
        df, step = df.transform(step), following.get(step)
    return df


def top_per_key(df: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_r") <= n).drop("_r")
