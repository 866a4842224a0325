"""User-defined surface (UDX-*): rules as data, compiled to columns."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import filters

_REGISTRY: dict[str, object] = {}


def register(plugin) -> None:
    """UDX-01/02: a format by name; Python entry points take the place of a binary interface."""
    _REGISTRY[plugin.name] = plugin


def registered() -> list:
    return sorted(_REGISTRY.values(), key=lambda p: (p.order, p.name))


def register_functions(spark: SparkSession) -> None:
    """The scalar functions that need Python, for SQL."""
    from ..functions.normalize import extract_all_json, extract_json

    spark.udf.register("extract_json", extract_json)
    spark.udf.register("extract_all_json", extract_all_json)


@dataclass(frozen=True)
class Aggregate:
    name: str
    kind: str  # count | sum
    pattern: str | None = None


@dataclass(frozen=True)
class Section:
    name: str
    enter: str
    exit: str | None = None
    match: str | None = None
    split_on: str | None = None
    keep: tuple[str, ...] = ()
    drop: tuple[str, ...] = ()
    aggregates: tuple[Aggregate, ...] = ()


@dataclass(frozen=True)
class StaticRule:
    """UDX-03."""

    sections: tuple[Section, ...]
    output_template: str | None = None
    name: str = "rule"
    meta: dict = field(default_factory=dict)


def load_rule(text: str) -> StaticRule:
    """A rule from TOML: [[sections]] with enter, exit, match, keep, drop, [[sections.aggregates]] and output_template."""
    raw = tomllib.loads(text)
    sections = tuple(Section(
        s["name"], s["enter"], s.get("exit"), s.get("match"), s.get("split_on"), tuple(s.get("keep", ())), tuple(s.get("drop", ())),
        tuple(Aggregate(a["name"], a["kind"], a.get("pattern")) for a in s.get("aggregates", ()))) for s in raw.get("sections", ()))
    return StaticRule(sections, raw.get("output_template"), raw.get("name", "rule"))


def section_lines(lines: DataFrame, s: Section) -> DataFrame:
    """FLT-04 and FLT-03 for one section."""
    body = filters.section(lines, s.enter, s.exit)
    if s.match:
        body = body.where(F.col("line").rlike(s.match))
    return body.where(filters.keep_drop(F.col("line"), list(s.keep), list(s.drop)))


def section_aggregates(body: DataFrame, s: Section) -> DataFrame:
    """(source_id, section, name, value): counts of lines that fit, sums of the first group's number."""
    aggs = [
        (F.count_if(F.col("line").rlike(a.pattern)) if a.kind == "count" and a.pattern else F.count(F.lit(1)) if a.kind == "count"
         else F.coalesce(F.sum(F.regexp_extract("line", a.pattern, 1).try_cast("double")), F.lit(0.0))).cast("double").alias(a.name) for a in s.aggregates]
    if not aggs:
        return None
    wide = body.groupBy("source_id").agg(*aggs)
    pairs = F.array(*[F.struct(F.lit(a.name).alias("name"), F.col(a.name).alias("value")) for a in s.aggregates])
    return wide.select("source_id", F.lit(s.name).alias("section"), F.explode(pairs).alias("p")).select("source_id", "section", "p.name", "p.value")


def apply_rule(lines: DataFrame, rule: StaticRule) -> tuple[DataFrame, DataFrame | None]:
    """UDX-03: (section lines, aggregates) of all sections."""
    bodies, sums = None, None
    for s in rule.sections:
        b = section_lines(lines, s)
        a = section_aggregates(b, s)
        b = b.withColumn("section", F.lit(s.name))
        bodies = b if bodies is None else bodies.unionByName(b)
        if a is not None:
            sums = a if sums is None else sums.unionByName(a)
    return bodies, sums


def split_records(text: Column, separator: str) -> Column:
    """UDX-04."""
    return F.filter(F.split(text, separator), lambda x: F.trim(x) != "")


def diagnose(rule: StaticRule, lines: DataFrame | None = None) -> list[dict]:
    """UDX-05: invalid patterns, equal enters, patterns both kept and dropped, equal keeps, and sections without a hit."""
    out = []
    for s in rule.sections:
        for kind, p in [("enter", s.enter), ("exit", s.exit), ("match", s.match), *[("keep", k) for k in s.keep], *[("drop", d) for d in s.drop]]:
            if p is not None:
                try:
                    re.compile(p)
                except re.error as e:
                    out.append({"code": "invalid_regex", "section": s.name, "field": kind, "detail": str(e)})
        out += [{"code": "keep_drop_overlap", "section": s.name, "field": p, "detail": ""} for p in sorted(set(s.keep) & set(s.drop))]
    for i, a in enumerate(rule.sections):
        for b in rule.sections[i + 1:]:
            if a.enter == b.enter:
                out.append({"code": "duplicate_enter", "section": a.name, "field": a.enter, "detail": b.name})
            out += [{"code": "keep_overlap", "section": a.name, "field": p, "detail": b.name} for p in sorted(set(a.keep) & set(b.keep))]
    if lines is not None and not any(x["code"] == "invalid_regex" for x in out):
        hits = lines.agg(*[F.count_if(F.col("line").rlike(s.enter)).alias(f"h{i}") for i, s in enumerate(rule.sections)]).first()
        out += [{"code": "no_hit", "section": s.name, "field": s.enter, "detail": ""} for i, s in enumerate(rule.sections) if not hits[f"h{i}"]]
    return out


def verify(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """UDX-06: fixtures whose text differs, line ends aside."""
    norm = lambda c: F.trim(F.regexp_replace(c, "[ \\t\\r]*\\n", "\n"))
    return actual.alias("a").join(expected.alias("e"), "file", "full_outer").where(~norm(F.col("a.text")).eqNullSafe(norm(F.col("e.text")))).select("file")


_TAG = re.compile(r"\{\{\s*(#if|#unless|/if|/unless)?\s*([A-Za-z0-9_.]*)\s*\}\}")


def render(template: str, values: dict) -> str:
    """UDX-07: ``{{var}}``, ``{{list.count}}``, ``{{list.items}}``, ``{{#if var}}..{{/if}}``, ``{{#unless var}}..{{/unless}}``."""
    def lookup(path: str):
        x = values
        for part in path.split("."):
            if isinstance(x, (list, tuple)) and part == "count":
                return len(x)
            if isinstance(x, (list, tuple)) and part == "items":
                return "\n".join(map(str, x))
            x = x.get(part) if isinstance(x, dict) else None
        return x

    out, shown, at = [], [True], 0
    for m in _TAG.finditer(template):
        if shown[-1]:
            out.append(template[at:m.start()])
        at = m.end()
        kind, name = m.group(1), m.group(2)
        if kind in ("#if", "#unless"):
            shown.append(shown[-1] and (bool(lookup(name)) == (kind == "#if")))
        elif kind:
            if len(shown) == 1:
                raise ValueError("a block is closed that was not opened")
            shown.pop()
        elif shown[-1]:
            v = lookup(name)
            out.append("" if v is None else str(v))
    if len(shown) > 1:
        raise ValueError("a block is not closed")
    return "".join([*out, template[at:]])


def template_driven(line: Column, rules: list[tuple[str, str]]) -> Column:
    """UDX-08: (pattern, template): the first pattern that fits a whole line renders its template, ``<*>`` in turn taking the groups' texts."""
    out = None
    for p, template in rules:
        pieces = template.split("<*>")
        parts: list[Column] = [F.lit(pieces[0])]
        for i, piece in enumerate(pieces[1:], 1):
            parts += [F.regexp_extract(line, p, i), F.lit(piece)]
        out = F.when(line.rlike(p), F.concat(*parts)) if out is None else out.when(line.rlike(p), F.concat(*parts))
    return F.coalesce(out, line) if out is not None else line


def config_format(spec: dict) -> tuple:
    """UDX-09: a plugin from data: {name, detect: [patterns], min_ratio, compress: [[pattern, replacement]], dedup}."""
    from .classify import match_share

    detect = lambda t: F.when(match_share(t, spec["detect"], spec.get("min_ratio", 0.15)), 0.8).otherwise(0.0)

    def compress(lines: DataFrame) -> DataFrame:
        c = F.col("line")
        for p, r in spec.get("compress", ()):
            c = F.regexp_replace(c, p, r)
        out = lines.withColumn("line", c)
        return filters.adjacent_unique(out) if spec.get("dedup") else out

    return detect, compress


def aliases(values: DataFrame, rules: list[tuple[str, str]], value: str = "value") -> DataFrame:
    """UDX-10: (alias, pattern): the first alias whose pattern a value fits; rules are few, so they are one expression."""
    out = F.lit(None).cast("string")
    for name, p in reversed(rules):
        out = F.when(F.col(value).rlike(p), name).otherwise(out)
    return values.withColumn("alias", out)
