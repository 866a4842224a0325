"""Sharding by fixed virtual slots.

Every record is hashed into one of ``SLOTS`` virtual slots, a number that never changes. Bytes are
summed for each slot, and a map from slots to shards is stored, with a version for each edit: version
1 deals the slots out in turn; every run loads the last version, edits it so that the shards' bytes are
near equal (or for another number of shards) and stores it as the next, if that changes anything. A
record moves only if its slot does. Law: ``bytes``. A store has one writer at a time; a version is whole
or not there, since its one file appears when its job is committed.

The map and the sums have SLOTS rows whatever the input, and only they reach the driver; records are
never gathered. A row's place in its shard is the count of the shard's rows in earlier (slot, part)
cells plus its rank in its own cell; a slot has PARTS cells by the record's hash, so that a key that
many rows share is ranked in many tasks.

Defined results: a null text has size 16 and the crc32 of no bytes; null ids are allowed and hash like
any value; equal rows get different places in the same shard; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, int_array, shared_dir, table, text_or_empty

SLOTS, PARTS, SHARDS, OVERHEAD = 4096, 16, 40, 16


def record_hash(key: str) -> Column:
    """Of the id and the text, so that rows that share an id (or have none) are spread as well."""
    return F.xxhash64(F.col(key), text_or_empty())


def slot_of(h: Column) -> Column:
    return F.pmod(h, F.lit(SLOTS)).cast("int")


def first_map(shards: int) -> list[int]:
    return [s % shards for s in range(SLOTS)]


def rebalance(owner: list[int], size: list[int], shards: int, steps: int = 20_000) -> list[int]:
    """The edited map: full shards give up slots, which go to the emptiest, largest first; then slots are moved or swapped between the fullest and the emptiest shard while that lessens their difference."""
    owner, total = list(owner), [0] * shards
    held: list[list[int]] = [[] for _ in range(shards)]
    mean, pool = sum(size) / shards, []
    for s, k in enumerate(owner):
        if k >= shards:  # a shard that is no more
            pool.append(s)
            continue
        total[k] += size[s]
        held[k].append(s)
    for k in range(shards):
        held[k].sort(key=lambda s: (size[s], s))
        while held[k] and total[k] > mean:
            s = held[k].pop()
            total[k] -= size[s]
            pool.append(s)
    heap = [(total[k], k) for k in range(shards)]
    heapq.heapify(heap)
    for s in sorted(pool, key=lambda s: (-size[s], s)):
        t, k = heapq.heappop(heap)
        owner[s] = k
        held[k].append(s)
        total[k] = t + size[s]
        heapq.heappush(heap, (total[k], k))
    for _ in range(steps):
        hi, lo = max(range(shards), key=total.__getitem__), min(range(shards), key=total.__getitem__)
        gap = total[hi] - total[lo]
        best = min(((abs(gap - 2 * size[s]), s, -1) for s in held[hi] if 0 < size[s] < gap), default=None)
        low = sorted(held[lo], key=size.__getitem__)
        j = 0
        for s in sorted(held[hi], key=size.__getitem__):
            want = size[s] - gap / 2
            while j + 1 < len(low) and size[low[j + 1]] <= want:
                j += 1
            for o in low[j:j + 2]:
                d = size[s] - size[o]
                if 0 < d < gap and (best is None or abs(gap - 2 * d) < best[0]):
                    best = (abs(gap - 2 * d), s, o)
        if best is None or best[0] >= gap:
            break
        _, s, o = best
        held[hi].remove(s)
        held[lo].append(s)
        owner[s] = lo
        if o >= 0:
            held[lo].remove(o)
            held[hi].append(o)
            owner[o] = hi
        d = size[s] - (size[o] if o >= 0 else 0)
        total[hi] -= d
        total[lo] += d
    return owner


def map_frame(spark: SparkSession, owner: list[int], version: int) -> DataFrame:
    return spark.range(SLOTS).select(
        F.lit(version).alias("version"), F.col("id").cast("int").alias("vslot"), F.element_at(int_array(owner), (F.col("id") + 1).cast("int")).alias("shard")
    )


def store_map(spark: SparkSession, path: str, version: int, owner: list[int]) -> None:
    map_frame(spark, owner, version).drop("version").coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema("vslot int, shard int").parquet(f"{path}/version={version}")


def last_version(spark: SparkSession, path: str) -> int:
    """0 if nothing is stored; versions without a committed job do not count."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    v = 0
    while fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/version={v + 1}/_SUCCESS")):
        v += 1
    return v


def edit(spark: SparkSession, path: str, size: list[int], shards: int) -> int:
    """Stores the next version of the map under path, near equal for these sizes of slots; returns the version that holds."""
    v = last_version(spark, path)
    if v == 0:
        store_map(spark, path, 1, first_map(shards))
        v = 1
    owner = [0] * SLOTS
    for r in load_map(spark, path, v).collect():  # SLOTS rows
        owner[r["vslot"]] = r["shard"]
    edited = rebalance(owner, size, shards)
    if edited != owner:
        v += 1
        store_map(spark, path, v, edited)
    return v


def assign(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", store: str | None = None) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard, vslot, map_version) for every row; other columns of docs go.

    store is the folder of the map's versions, on storage that all nodes share. Without one the map begins anew, so
    that the result depends on docs alone."""
    spark = docs.sparkSession
    h = record_hash(key)
    rows = docs.select(
        F.col(key), (F.octet_length(text_or_empty()) + OVERHEAD).cast("bigint").alias("size"), F.crc32(text_or_empty()).alias("text_crc32"),
        slot_of(h).alias("vslot"), F.pmod(F.shiftright(h, 32), F.lit(PARTS)).cast("int").alias("part"),
    )
    # SLOTS * PARTS rows, whatever the input
    cells = rows.groupBy("vslot", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    cells = cut(cells, "cells")
    size = [0] * SLOTS
    for r in cells.groupBy("vslot").agg(F.sum("bytes").alias("b")).collect():
        size[r["vslot"]] = r["b"]
    store = (store or f"{shared_dir(spark)}/textsieve/slotmap-{uuid.uuid4().hex}").rstrip("/")
    version = edit(spark, store, size, shards)
    current = F.broadcast(load_map(spark, store, version))
    before = Window.partitionBy("shard").orderBy("vslot", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.join(current, "vslot").select("vslot", "part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("vslot", "part").orderBy(key, "text_crc32", "size"))
    return (
        rows.withColumn("rank", rank)
        .join(F.broadcast(starts), ["vslot", "part"])
        .select(key, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("rank") - 1).cast("bigint").alias("slot"),
                F.lit(None).cast("int").alias("grown_shard"), "vslot", F.lit(version).alias("map_version"))
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))
