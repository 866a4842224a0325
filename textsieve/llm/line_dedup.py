"""Substring dedup by hashes of lines and sentences.

A text is cut into units: its lines, and inside them the pieces that end with ``.``, ``!`` or ``?``, so
that a passage is found wherever in a line it was put. A unit is normalised (lower case, everything but
letters and digits to one blank). Its digest is that of the shortest run of units that ends with it and
has ``min_words`` words or more: a long unit is hashed alone, a short one together with what stands
before it, so that ``Yes.`` alone never counts as a copy. Units without a word have no digest.

Digests are grouped globally; the occurrence in the smallest doc_id, at its first place there, stays and
every other one goes, if it is part of a run of such units (one behind the other) that has ``min_run`` words or
more: 0 takes out every repeated unit, ``MIN_RUN`` (the query's and the pipeline's) repeated passages, and
leaves headings, license lines and formulas that many documents share by themselves. Offsets are code points of
the original text.

Each text is hashed once; its digests (each one once for a document) are written and read twice. Counts and
smallest ids are summed before they are shuffled, so that a line that a third of the documents share is one row
from each task. Only digests that occur in several documents are then joined to the documents' digests (both
sides shuffled, so that Spark can split a hot one), and gathered by document: at most as many as the document has
units. Only texts that have such digests, or one digest twice, are cut into units again.

Defined results: null and empty texts come back as they are, with no units; rows that share a doc_id are
one document, and lose only what they repeat themselves or what smaller ids have; rows with a null id
come last and lose what rows with an id have; an empty table gives no rows; extra columns stay.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, slices, table, text_or_empty

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_WORDS, MIN_RUN = 8, 25
UNIT = r"[^.!?\n]*[.!?\n]+[ \t]*|[^.!?\n]+"
UNITS, OTHER = re.compile(UNIT).findall, re.compile(r"[\W_]+")


def digests(text: str, min_words: int = MIN_WORDS) -> tuple[list[str], list[int | None], list[int]]:
    """A text's units, the first 64 bits of each one's digest, and its words."""
    units = UNITS(text)
    out: list[int | None] = []
    words: list[int] = []
    run: list[tuple[str, int]] = []
    for u in units:
        norm = OTHER.sub(" ", u.lower()).strip()
        n = norm.count(" ") + 1 if norm else 0
        words.append(n)
        if not norm:
            out.append(None)
            continue
        if n >= min_words:
            run = [(norm, n)]
        else:
            run.append((norm, n))
            while len(run) > 1 and sum(k for _, k in run[1:]) >= min_words:
                run.pop(0)
        if sum(k for _, k in run) < min_words:
            out.append(None)
        else:
            out.append(int.from_bytes(blake2b(" ".join(x for x, _ in run).encode(), digest_size=8).digest(), "little", signed=True))
    return units, out, words


def _digest_rows(min_words: int):
    """Rows (id, a, twice): each digest of a row once, and whether it occurs there more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = [Counter(d for d in digests(t, min_words)[1] if d is not None) for t in batch.column(1).to_pylist()]
            take = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]))
            a = pa.array([d for x in own for d in x], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), a, pa.array([n > 1 for x in own for n in x.values()], pa.bool_())], names=["id", "a", "twice"])

    return run


def repeated(docs: DataFrame, min_words: int = MIN_WORDS, files: int | None = None) -> DataFrame:
    """docs (id, text) -> (id, again): the digests that a smaller id has; none for documents that only repeat themselves."""
    kind = dict(docs.dtypes)["id"]
    rows = cut(docs.mapInArrow(_digest_rows(min_words), f"id {kind}, a bigint, twice boolean"), "digests", files)
    first = rows.groupBy("a").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "first")
    again = rows.select("id", "a").join(first, "a").where(~F.col("id").eqNullSafe(F.col("first"))).select("id", "a")
    own = rows.where("twice").select("id", F.lit(None).cast("bigint").alias("a"))
    return again.unionByName(own).groupBy("id").agg(F.collect_set("a").alias("again"))


def _cleaned(min_words: int, min_run: int):
    """The last two columns are the text and the digests to remove (null: no unit can go)."""

    def cuts_of(text: str, again: set[int]) -> tuple[list[list[int]], int, int]:
        units, own, words = digests(text, min_words)
        seen: set[int] = set()
        runs: list[list[int]] = []  # start, end, words, units
        at = 0
        for u, d, n in zip(units, own, words, strict=True):
            if d is not None and (d in again or d in seen):
                if runs and runs[-1][1] == at:
                    runs[-1][1:] = [at + len(u), runs[-1][2] + n, runs[-1][3] + 1]
                else:
                    runs.append([at, at + len(u), n, 1])
            if d is not None:
                seen.add(d)
            at += len(u)
        runs = [r for r in runs if r[2] >= min_run]
        return [r[:2] for r in runs], len(units), sum(r[3] for r in runs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, gone = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1)
            kept, spans, units_n, removed_n = [], [], [], []
            for i, t in enumerate(texts):
                if not gone[i].is_valid:
                    cuts, n, k = [], len(UNITS(t or "")), 0
                else:
                    cuts, n, k = cuts_of(t or "", set(gone[i].values.to_numpy().tolist()))
                ends = [0, *[b for _, b in cuts]]
                kept.append("".join([*[t[a:b] for a, (b, _) in zip(ends, cuts)], t[ends[-1]:]]) if cuts else t)
                spans.append(";".join(f"{a}-{b}" for a, b in cuts))
                units_n.append(n)
                removed_n.append(k)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array(kept, pa.string()), pa.array(units_n, pa.int64()), pa.array(removed_n, pa.int64()), pa.array(spans, pa.string())],
                names=[*batch.schema.names[:-2], "text", "n_units", "n_removed", "removed"])

    return run


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, key: str = "doc_id", min_run: int = 0, files: int | None = None) -> DataFrame:
    """docs with text cleaned, and n_units, n_removed and removed: the spans taken out as ``start-end;...`` (columns of these names are replaced).

    files: the digests are written in no more than these, as in cut()."""
    again = repeated(docs.select(F.col(key).alias("id"), text_or_empty().alias("text")), min_words, files).select(F.col("id").alias("_rid"), F.col("again").alias("_again"))
    others = [c for c in docs.columns if c not in ("text", "n_units", "n_removed", "removed")]
    ready = docs.join(again, F.col(key).eqNullSafe(F.col("_rid")), "left").select(*others, F.col("text").alias("_text"), "_again")
    kinds = ", ".join(f"`{n}` {t}" for n, t in ready.dtypes[:-2])
    made = ready.mapInArrow(_cleaned(min_words, min_run), f"{kinds}, text string, n_units bigint, n_removed bigint, removed string")
    return made.select(*docs.columns, *[c for c in ("n_units", "n_removed", "removed") if c not in docs.columns])


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs, min_run=MIN_RUN).select("doc_id", "n_units", "n_removed", "removed", "text")


_runs = "\n".join(
    f"when {' + '.join(['nw', *[f'coalesce(lag(nw, {i}) over w, 0)' for i in range(1, k + 1)]])} >= {MIN_WORDS} then {' || chr(32) || '.join([*[f'lag(norm, {i}) over w' for i in range(k, 0, -1)], 'norm'])}"
    for k in range(MIN_WORDS))
OP2_SQL = rf"""
with u0 as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^.!?\n]*[.!?\n]+[ \t]*|[^.!?\n]+') as a from documents),
u as (select doc_id, unnest(a) as unit, generate_subscripts(a, 1) as no from u0),
n as (select *, trim(regexp_replace(lower(unit), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) as norm,
      coalesce(sum(length(unit)) over (partition by doc_id order by no rows between unbounded preceding and 1 preceding), 0) as start from u),
c as (select *, length(norm) - length(replace(norm, ' ', '')) + 1 as nw from n where norm <> ''),
r as (select *, case {_runs} end as run from c window w as (partition by doc_id order by no)),
g as (select doc_id, no, row_number() over (partition by run order by doc_id, no) > 1 as gone from r where run is not null),
p as (select n.*, coalesce(g.gone, false) as gone from n left join g using (doc_id, no)),
i as (select *, no - row_number() over (partition by doc_id, gone order by no) as island from p),
s as (select * exclude (gone), gone and sum(case when norm = '' then 0 else length(norm) - length(replace(norm, ' ', '')) + 1 end) over (partition by doc_id, gone, island) >= {MIN_RUN} as gone from i),
spans as (select doc_id, string_agg(sp, ';' order by a) as removed from (
   select doc_id, island, min(start) as a, cast(min(start) as varchar) || '-' || cast(max(start + length(unit)) as varchar) as sp from s where gone group by doc_id, island) group by doc_id)
select d.doc_id, cast(coalesce(k.n_units, 0) as bigint) as n_units, cast(coalesce(k.n_removed, 0) as bigint) as n_removed, coalesce(spans.removed, '') as removed,
  case when coalesce(k.n_removed, 0) = 0 then d.text else coalesce(k.text, '') end as text
from documents d
left join (select doc_id, count(*) as n_units, count(*) filter (gone) as n_removed, string_agg(unit, '' order by no) filter (not gone) as text from s group by doc_id) k on k.doc_id = d.doc_id
left join spans on spans.doc_id = d.doc_id
"""
