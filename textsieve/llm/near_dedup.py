"""Near-duplicate classes by ProbMinHash.

Documents are weighted sets of five-word shingles (weight ``1 + ln(count)``). Each shingle emits a
Poisson process whose rate is its weight; every arrival falls into one of ``REGISTERS`` registers, which
keeps the shingle of its earliest arrival; a shingle stops as soon as its next arrival is later than
every register's. Two documents agree in a register with the probability Jaccard similarity of their
weighted sets. Registers are cut into ``BANDS`` bands; documents that share a band's hash are candidates, and are
verified by the exact Jaccard similarity of their shingle sets (0.8 or more). Since the sets have no weights,
texts that repeat shingles also have the bands of unit weights (for all others those are the same ones): a pair of
set similarity 0.8 is a candidate with probability ``1 - (1 - 0.8 ** 5) ** 25`` = 0.99995, whatever its counts.

Classes are connected components of verified links. Copies (equal word sequences) are collapsed before
anything else, and no bucket is expanded into all its pairs: each bucket's members are first compared
with its most central member (the one whose buckets have the most members in all). Then only buckets that still
hold several components matter: if they have at most ``SMALL`` members, members of different components are compared,
each with each. The members of larger ones are joined by their rarest shingles: a set that is similar enough to
another shares one of its first ``n - ceil(SIMILAR n) + 1`` shingles in any common order, at places that leave enough
of both sets behind them. The order is by the shingles' counts in a table of ``SLOTS`` counters (4 MB, whatever the
input); counters that several shingles share make it coarser, never wrong. No pair of the class is lost by that, so
that nothing is left to compare afterwards.

Defined results: texts without any word (null and empty ones too) are copies of each other; texts of
fewer than five words have one shingle, all their words; a row with a null id has a null class and takes
part in nothing; rows that share an id are one document; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import FILE, cut, drop_cut, slices, table, text_or_empty
from .components import components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS, SIMILAR, BANDS, ROWS, SMALL, BLOCK, SLOTS, HOT = 5, 0.8, 25, 5, 64, 256, 1 << 20, 1000
KEYS_FILE, SETS_FILE = 1 << 15, 1 << 12  # documents in a file of their keys and pairs (narrow), and of their sets (wide)
REGISTERS = BANDS * ROWS
A, B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-case words, padded to one shingle if there are fewer than five."""
    k = F.transform(F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    return F.when((F.size(k) > 0) & (F.size(k) < WORDS), F.concat(k, F.array_repeat(F.lit(0).cast("bigint"), F.lit(WORDS) - F.size(k)))).otherwise(k)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * B
    x = (x ^ (x >> np.uint64(27))) * C
    return x ^ (x >> np.uint64(31))


def shingles(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the flat word hashes of many documents: (document, shingle, count), sorted, each shingle once."""
    n = len(values) - WORDS + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    v = values.view(np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(WORDS):
        h = mix((h + A) ^ v[i:n + i])
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = doc[:n] == doc[WORDS - 1:]
    h, doc = h[whole], doc[:n][whole]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def prob_min_hash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, registers: int = REGISTERS) -> np.ndarray:
    """The registers (documents x registers) of weighted sets: the element of the earliest arrival; 0 where there is none."""
    first = np.full(docs * registers, np.inf)
    held = np.zeros(docs * registers, np.uint64)
    at = np.zeros(len(element))
    live = np.arange(len(element))
    limit = np.full(docs, np.inf)
    step = 0
    while len(live):
        e = element[live]
        r = mix(e + np.uint64(int(A) * (step + 1) & (1 << 64) - 1))
        at[live] += -np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / weight[live]
        t, d = at[live], doc[live]
        soon = t < limit[d]
        live, t, d, e, r = live[soon], t[soon], d[soon], e[soon], r[soon]
        place = d * registers + (mix(r + A) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, place, t)
        won = first[place] == t
        held[place[won]] = e[won]
        touched = np.unique(d)
        limit[touched] = first.reshape(docs, registers)[touched].max(axis=1)
        live = live[t < limit[d]]
        step += 1
    return held.reshape(docs, registers)


def band_keys(held: np.ndarray) -> np.ndarray:
    """One hash for each band."""
    keys = np.zeros((len(held), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * A
    for i in range(ROWS):
        keys = mix(keys ^ held[:, i::ROWS])
    return keys.view(np.int64)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]].astype(np.int64), offsets - offsets[0]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        values, offsets = _flat(batch.column(3))
        doc, element, count = shingles(values, offsets)
        weighted = band_keys(prob_min_hash(doc, element, 1 + np.log(count), batch.num_rows))
        some = np.diff(offsets) > 0
        uneven = np.zeros(batch.num_rows, bool)
        uneven[doc[count > 1]] = True
        own = uneven[doc]
        number = np.cumsum(uneven) - 1
        unit = band_keys(prob_min_hash(number[doc[own]], element[own], np.ones(own.sum()), uneven.sum()))
        keys = [np.unique(np.concatenate([weighted[i], unit[number[i]]])) if uneven[i] else weighted[i] for i in np.flatnonzero(some)]
        sizes = np.zeros(batch.num_rows, np.int64)
        sizes[some] = [len(k) for k in keys]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists], names=["id", "c1", "c2", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        values, offsets = _flat(batch.column(1))
        doc, element, _ = shingles(values, offsets)
        short = (element >> np.uint64(32)).astype(np.uint32).view(np.int32)
        ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=batch.num_rows))])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(short))], names=["id", "s"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, ok): whether the pair's Jaccard similarity is enough."""
    left, right = sets.select(F.col("id").alias("a"), F.col("s").alias("_l")), sets.select(F.col("id").alias("b"), F.col("s").alias("_r"))
    both = F.size(F.array_intersect("_l", "_r"))
    sizes = F.size("_l") + F.size("_r")
    close = F.least(F.size("_l"), F.size("_r")) >= SIMILAR * F.greatest(F.size("_l"), F.size("_r"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", F.when(close, both >= SIMILAR * (sizes - both)).otherwise(False).alias("ok"))


def _ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _slots(s: np.ndarray) -> np.ndarray:
    return (mix(s.astype(np.int64).view(np.uint64) + A) % np.uint64(SLOTS)).astype(np.int64)


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (slot, n): a task's counters."""
    counts = np.zeros(SLOTS, np.int64)
    for batch in slices(batches):
        counts += np.bincount(_slots(_flat(batch.column(0))[0]), minlength=SLOTS)
    slot = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(counts[slot])], names=["slot", "n"])


def _prefixes(counts):
    """Rows (id, label, n, s, at, df): of each set the rarest shingles that any set as similar must meet, without those that no other has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values, offsets = _flat(batch.column(2))
            often = counts.value[_slots(values)]
            size = np.diff(offsets)
            row = np.repeat(np.arange(batch.num_rows), size)
            order = np.lexsort((values, often, row))  # rows stay together
            at = np.arange(len(values)) - offsets[row] + 1
            keep = (at <= (size - np.ceil(SIMILAR * size - 1e-9) + 1)[row]) & (often[order] > 1)
            take = pa.array(row[keep])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(size[row[keep]]), pa.array(values[order][keep]), pa.array(at[keep]), pa.array(often[order][keep])],
                names=["id", "label", "n", "s", "at", "df"])

    return run


def _rare_pairs(large: DataFrame, sets: DataFrame, files: int) -> DataFrame:
    """(a, b): all pairs of large's (id, label) of different labels that can be similar enough, by prefix, length and position; more than those, but not all pairs.

    Members of a label with the shingle at the same place are joined in blocks, so that those of the same label are not paired with each other."""
    kind = dict(large.dtypes)["id"]
    rows = cut(large.join(sets, "id").select("id", "label", "s"), "large", files)
    sums = rows.select("s").mapInArrow(_slot_counts, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SLOTS, np.int32)
    counts[sums.column("slot").to_numpy()] = np.minimum(sums.column("n").to_numpy(), 2**31 - 1)
    shared = large.sparkSession.sparkContext.broadcast(counts)
    prefix = rows.mapInArrow(_prefixes(shared), f"id {kind}, label {kind}, n bigint, s bigint, at bigint, df int")
    blocks = prefix.groupBy("s", "label", "n", "at", F.pmod(F.xxhash64("id"), F.ceil(F.col("df") / BLOCK)).alias("block")).agg(F.collect_list("id").alias("m"))
    several = blocks.groupBy("s").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("s")
    blocks = cut(blocks.join(several, "s"), "blocks", files)
    other = blocks.select("s", F.col("label").alias("label2"), F.col("n").alias("n2"), F.col("at").alias("at2"), F.col("m").alias("m2"))
    close = (F.least("n", "n2") >= SIMILAR * F.greatest("n", "n2") - 1e-9) & (
        (1 + F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2"))) * (1 + SIMILAR) >= SIMILAR * (F.col("n") + F.col("n2")) - 1e-6)
    both = blocks.join(other, "s").where((F.col("label") < F.col("label2")) & close)
    pairs = both.select(F.explode("m").alias("x"), "m2").select("x", F.explode("m2").alias("y"))
    return pairs.select(F.col("x").alias("id"), F.col("y").alias("id2")).select(*_ordered("id", "id2"))


def _named(rows: DataFrame, named: DataFrame) -> DataFrame:
    """rows with their group's (c1, c2) columns. Groups of at least a share of 1 / HOT of the rows, of which there are at most
    HOT, are broadcast, so that no task has more of one group than that share."""
    least = F.lit(max(rows.count() // HOT, 1) + 1)
    large = F.broadcast(named.where(F.col("copies") >= least))
    rest = rows.join(large.select("c1", "c2"), ["c1", "c2"], "left_anti")
    return rows.join(large, ["c1", "c2"]).unionByName(rest.join(named.where(F.col("copies") < least), ["c1", "c2"]))


def classes(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, class_id, copy_of): class_id is the smallest id of the document's class, copy_of that of the documents with the same words."""
    n = docs.count()
    files = -(-n // KEYS_FILE)
    words = docs.select(F.col(key).alias("id"), text_or_empty().alias("text")).where(F.col("id").isNotNull()).withColumn("k", word_hashes(F.col("text")))
    signed = cut(
        words.select("id", F.xxhash64("k").alias("c1"), F.xxhash64(F.lit(3), "k").alias("c2"), "k")
        .mapInArrow(_signatures, f"id {dict(docs.dtypes)[key]}, c1 bigint, c2 bigint, bands array<bigint>"), "signatures", -(-n // FILE))
    # written, so that the join with the representatives is dealt by id as well and a group of copies is not one task
    first = cut(signed.groupBy("c1", "c2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "first", files)
    reps = signed.join(first, (signed["id"] == first["rep"]) & (signed["c1"] == first["c1"]) & (signed["c2"] == first["c2"]), "left_semi").dropDuplicates(["c1", "c2"])
    members = reps.select(F.explode("bands").alias("bucket"), "id")
    several = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = cut(members.join(several, "bucket"), "buckets", files)  # only of buckets with several members
    central = members.join(members.groupBy("id").agg(F.sum("n").alias("_weight")), "id")
    hubs = central.groupBy("bucket").agg(F.max(F.struct("_weight", "id")).alias("_hub")).select("bucket", F.col("_hub.id").alias("hub"))
    star = members.join(hubs, "bucket").where("id <> hub").select(*_ordered("id", "hub")).distinct()
    wanted = members.select("id").distinct()
    texts = words.select("id", "text").join(wanted, "id", "left_semi")
    sets = cut(texts.dropDuplicates(["id"]).select("id", word_hashes(F.col("text")).alias("k")).mapInArrow(_sets, f"id {dict(docs.dtypes)[key]}, s array<int>"), "sets", -(-n // SETS_FILE))
    tested = cut(_verified(star, sets), "tested", files)
    labels = components(tested.where("ok"))
    placed = members.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    mixed = placed.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("bucket")
    open_ = cut(placed.join(mixed, "bucket"), "open", files)
    x, y = open_.where(f"n <= {SMALL}").select("bucket", "id", "label"), open_.where(f"n <= {SMALL}").select("bucket", F.col("id").alias("id2"), F.col("label").alias("label2"))
    small = x.join(y, "bucket").where("id < id2 and label <> label2").select(*_ordered("id", "id2"))
    large = open_.where(f"n > {SMALL}").select("id", "label").distinct()
    wide = small if large.isEmpty() else small.union(_rare_pairs(large, sets, files))
    pairs = cut(wide.distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti"), "pairs", files)
    if not pairs.isEmpty():
        tested = cut(tested.unionByName(_verified(pairs, sets)), "tested", files)
        labels = components(tested.where("ok"))
    named = first.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("c1", "c2", "rep", "copies", F.coalesce("label", "rep").alias("class_id"))
    drop_cut(sets)
    result = _named(signed.select("id", "c1", "c2"), named).select(F.col("id").alias(key), "class_id", F.col("rep").alias("copy_of"))
    without = docs.where(F.col(key).isNull()).select(key, F.lit(None).cast(dict(docs.dtypes)[key]).alias("class_id"), F.lit(None).cast(dict(docs.dtypes)[key]).alias("copy_of"))
    return result.unionByName(without)


def keep_first(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs with one document of each class; of rows that are the same document (id and text) one stays, those with a null id stay all."""
    ids = docs.agg(F.count(key).alias("n"), F.countDistinct(key).alias("d")).first()
    if ids["n"] != ids["d"]:
        docs = docs.where(F.col(key).isNotNull()).dropDuplicates([key, "text"]).unionByName(docs.where(F.col(key).isNull()))
    gone = classes(docs, key).where(F.col(key) != F.col("class_id")).select(F.col(key).alias("_gone")).distinct()
    return docs.join(gone, F.col(key) == F.col("_gone"), "left_anti")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
