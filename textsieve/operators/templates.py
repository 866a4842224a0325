"""Template mining (DRN-*).

The leaf that a message falls into depends on its token count and its second to fourth tokens only, up
to the limit of 100 children of a node, which is settled for all nodes of a level at once by ranking the
children by first appearance. Inside a leaf templates evolve with the messages' order, so a leaf is read
as a sorted stream that keeps the templates only. Templates change seldom: a batch's messages are compared with all
templates at once, and anew only from the message on that made or changed one.
"""

from __future__ import annotations

import re
import sys
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values.
DELIMITERS, DEPTH, SIMILAR, CHILDREN = r"[ =,:;\[\]()]", 4, 0.5, 100
WILD = "<*>"
TIMES = (r"^\[?[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}[.0-9]*Z?\]?[ \t]*", r"^[0-9]{4}/[0-9]{2}/[0-9]{2}[ \t]+[0-9]{2}:[0-9]{2}:[0-9]{2}[ \t]*")


def tokens(line: Column) -> Column:
    """DRN-01."""
    return F.filter(F.split(line, DELIMITERS), lambda x: x != "")


def with_leaf(lines: DataFrame, children: int = CHILDREN) -> DataFrame:
    """DRN-02: adds toks and leaf (null for messages of fewer than two tokens, which are never clustered).

    A message's leaf depends on its size and branches alone, so the tree is settled on the distinct ones of these, which are
    written once; the messages are read twice, however deep the tree."""
    names = [f"_b{depth}" for depth in range(2, DEPTH + 1)]
    df = lines.withColumn("toks", tokens(F.col("line"))).withColumn("_n", F.size("toks"))
    for i, name in enumerate(names, 1):
        t = F.get("toks", F.lit(i))
        df = df.withColumn(name, F.when(t.rlike("[0-9]"), WILD).otherwise(t))
    nodes = df.groupBy("_n", *names).agg(F.min(F.struct("source_id", "line_no")).alias("_place"))
    nodes = written(nodes, "nodes").where("_n >= 2").withColumn("leaf", F.col("_n").cast("string"))
    for name in names:
        firsts = nodes.where(F.col(name).isNotNull()).groupBy("leaf", name).agg(F.min("_place").alias("_first"))
        # a node's first CHILDREN branches stay; later ones fall into <*>, which is there from then on and counts if it came early
        order = Window.partitionBy("leaf").orderBy("_first")
        branch = firsts.withColumn("_rank", F.row_number().over(order)).select("leaf", name, F.when((F.col("_rank") <= children) | (F.col(name) == WILD), F.col(name)).otherwise(WILD).alias("_to"))
        nodes = nodes.join(branch, ["leaf", name], "left").withColumn("leaf", F.when(F.col("_to").isNull(), F.col("leaf")).otherwise(F.concat_ws("\x1f", "leaf", "_to"))).drop("_to")
    settled = written(nodes.select(*[F.col(c).alias(f"{c}r") for c in ("_n", *names)], "leaf"), "leaves")
    on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"{c}r")) for c in names], F.col("_n") == F.col("_nr"))
    return df.join(settled, on, "left").drop("_n", "_nr", *names, *[f"{c}r" for c in names])


CELLS = 1 << 20  # comparisons of a message with a template at a time
KNOWN = 100_000  # sequences that a leaf remembers; beyond it they are searched for again


class Leaf:
    """DRN-03: the templates of one leaf, as [template, size, first place]; messages come in order."""

    def __init__(self):
        self.clusters: list[list] = []
        self.known: dict[tuple, list] = {}

    def add(self, toks: tuple, weight: int, place: object) -> None:
        hit = self.known.get(toks)
        if hit is None:
            hit = self._find(toks, place)
            if len(self.known) >= KNOWN:
                self.known.clear()
            self.known[toks] = hit
        hit[1] += weight

    def _find(self, toks: tuple, place: object) -> list:
        best, most = None, -1.0
        for c in self.clusters:
            if len(c[0]) != len(toks):
                continue
            sim = sum(a == b for a, b in zip(c[0], toks, strict=True)) / len(toks)
            if sim >= SIMILAR and sim > most:
                best, most = c, sim
        if best is None:
            best = [list(toks), 0, place]
            self.clusters.append(best)
            self.known.clear()
        else:
            merged = [a if a == b else WILD for a, b in zip(best[0], toks, strict=True)]
            if merged != best[0]:
                best[0] = merged
                self.known.clear()  # another template may now be the nearest one
        return best


    def extend(self, codes: np.ndarray, names: pa.Array, place) -> None:
        """add() of messages of one size in their order. codes has a row a token and a column a message, numbers of names; place gives
        a column's place. As many messages at a time as leave all templates as they are."""
        k, n = codes.shape
        own = [c for c in self.clusters if len(c[0]) == k]
        words = [w for c in own for w in c[0]]
        held = pc.fill_null(pc.index_in(pa.array(words, names.type), value_set=names), -1).to_numpy().reshape(-1, k).copy()
        wild = np.array([w == WILD for w in words], bool).reshape(-1, k)
        star, at, step = pc.index(names, WILD).as_py(), 0, n
        while at < n:
            part = codes[:, at:at + max(1, min(step, CELLS // max(1, len(own))))]
            same = np.zeros((len(own), part.shape[1]), np.int32)
            for i, template in enumerate(held):
                for row, code in zip(part, template, strict=True):
                    if code >= 0:
                        same[i] += row == code
            best = same.argmax(axis=0) if own else np.zeros(part.shape[1], np.int64)
            near = same.max(axis=0) / k >= SIMILAR if own else np.zeros(part.shape[1], bool)
            stays = near.copy()
            for i in np.unique(best[near]):
                mine = np.flatnonzero(near & (best == i))
                for row, code in zip(part[~wild[i]], held[i][~wild[i]], strict=True):
                    stays[mine] &= row[mine] == code
            first = len(stays) if stays.all() else int(stays.argmin())
            for i, size in enumerate(np.bincount(best[:first], minlength=len(own))):
                own[i][1] += int(size)
            at += first
            step *= 4
            if first < len(stays):  # a message that makes or changes a template
                row = codes[:, at]
                if near[first]:
                    i = best[first]
                    wild[i] |= held[i] != row
                    held[i][wild[i]] = star
                    own[i][0] = [WILD if x else t for t, x in zip(own[i][0], wild[i], strict=True)]
                    own[i][1] += 1
                else:
                    new = [names.take(pa.array(row)).to_pylist(), 1, place(at)]
                    own.append(new)
                    self.clusters.append(new)
                    held, wild = np.vstack([held, row]), np.vstack([wild, row == star])
                self.known.clear()
                at, step = at + 1, 64


def grow(messages: list[tuple[list[str], int, object]]) -> list[tuple[list[str], int, object]]:
    """DRN-03 for messages in order: (template, size, first place)."""
    leaf = Leaf()
    for toks, weight, place in messages:
        leaf.add(tuple(toks), weight, place)
    return [tuple(c) for c in leaf.clusters]


def mine(lines: DataFrame) -> DataFrame:
    """DRN-03: (template, size, first_source, first_line) of all leaves."""
    own = with_leaf(lines).where("leaf is not null").select("leaf", "toks", "source_id", "line_no")

    def rows(leaf: Leaf, types: list[pa.DataType]) -> pa.RecordBatch:
        found = [(t, size, *first) for t, size, first in leaf.clusters]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), types, strict=True)], names=["template", "size", "first_source", "first_line"])

    def leaves(batches):
        name, leaf, types = None, None, None
        for batch in batches:
            keys, toks, source, line = batch.columns
            types = [pa.list_(pa.string()), pa.int64(), source.type, line.type]
            new = np.flatnonzero(pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)) + 1
            for lo, hi in pairwise([0, *new.tolist(), batch.num_rows]):
                if lo == hi:
                    continue
                if keys[lo].as_py() != name:
                    if leaf:
                        yield rows(leaf, types)
                    name, leaf = keys[lo].as_py(), Leaf()
                # all messages of a leaf have its number of tokens
                coded = toks.slice(lo, hi - lo).flatten().dictionary_encode()
                codes = np.ascontiguousarray(coded.indices.to_numpy().reshape(hi - lo, -1).T)
                leaf.extend(codes, coded.dictionary, lambda i, lo=lo, source=source, line=line: (source[lo + i].as_py(), line[lo + i].as_py()))
        if leaf:
            yield rows(leaf, types)

    kind = dict(lines.dtypes)["source_id"]
    dealt = own.repartition("leaf").sortWithinPartitions("leaf", "source_id", "line_no")
    return dealt.mapInArrow(leaves, f"template array<string>, size bigint, first_source {kind}, first_line bigint")


def without_time(line: Column) -> Column:
    """DRN-04: messages without the time that they begin with."""
    for p in TIMES:
        line = F.regexp_replace(line, p, "")
    return line


def top_templates(templates: DataFrame, least: int = 6, n: int = 20) -> DataFrame:
    """DRN-04: templates of more than five messages, the largest first."""
    return templates.where(F.col("size") >= least).withColumn("text", F.array_join("template", " ")).orderBy(F.desc("size"), "text").limit(n).select("text", "size")


def template_regex(template: list[str]) -> str:
    """DRN-05: a template as a pattern; groups are not named, as names would repeat."""
    out = []
    for t in template:
        if t == WILD:
            out.append("(.*?)")
        elif re.fullmatch("[0-9a-fA-F]{9,}", t) and re.search("[a-fA-F]", t):
            out.append("[0-9a-fA-F]+")
        elif t.isdigit():
            out.append("[0-9]+")
        else:
            out.append("".join("\\" + c if c in "\\.[]{}()*+?^$|" else c for c in t))
    return r"\s+".join(out)
