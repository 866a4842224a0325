"""URL filter with a Bloom filter cascade.

A list of keys (hosts, or host plus leading path) is encoded over the complete universe of keys
that the corpus contains: level 0 is a Bloom filter of the listed keys, level 1 one of the corpus
keys that level 0 takes for listed ones, level 2 one of the listed keys that level 1 takes for
false positives, and so on until a level has no false positive. Membership of any key of the
universe is then exact, and is tested row by row without a join.

Level 0's false positive rate is chosen as sqrt(1/2) * listed / universe, so that level 1 holds
fewer keys than the list itself: the cascade has about 1.44 * log2(universe / listed) bits a listed
key, whatever the corpus. Its size is computed before anything is built; lists whose cascade would
be larger than ``max_bytes`` are matched by a shuffled join instead (``listed_by_join``).

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is
allowed. Repeated rows are judged alike. Other columns are ignored.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: (verdict, host, path): a rule fits its host and all subdomains if the path starts with the rule's.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Listed domains of the sample corpus; they and their subdomains are blocked where no rule fits.
LISTED = tuple(f"{name}.example.{top}" for name in ("spam-farm", "cheap-pills", "casino-win", "free-bets", "ads-track", "adult-x") for top in ("com", "net", "org"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def host_suffixes(host: Column) -> Column:
    """a.b.c -> [c, b.c, a.b.c]; empty host -> no suffix."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(parts, n - k + 1, k), "."))
    )


def path_prefixes(path: Column, depth: int) -> Column:
    """/a/b/c -> [/, /a/, /a/b/], no more than depth slashes deep; rules that end in a slash need no others."""
    slashes = F.size(F.split(path, "/")) - 1
    return F.when(~path.startswith("/"), F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.least(slashes, F.lit(depth))), lambda k: F.concat(F.call_function("substring_index", path, F.lit("/"), k), F.lit("/")))
    )


def candidates(host: Column, path: Column, depth: int) -> Column:
    hosts, paths = host_suffixes(host), path_prefixes(path, depth)
    return F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))


def hashes(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(7), key).alias("b"))


class Level:
    """A Bloom filter; bits by double hashing, modulo a power of two."""

    def __init__(self, a: np.ndarray, b: np.ndarray, rate: float, salt: int):
        bits = max(64.0, -len(a) * math.log(rate) / math.log(2) ** 2)
        self.bits, self.salt = 1 << math.ceil(math.log2(bits)), salt
        self.k = max(1, round(-math.log2(rate)))
        self.words = np.zeros(self.bits // 8, dtype=np.uint8)
        for p in self._places(a, b):
            np.bitwise_or.at(self.words, p >> 3, np.uint8(1) << (p & 7).astype(np.uint8))

    def _places(self, a: np.ndarray, b: np.ndarray):
        x = a.astype(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15 * (self.salt + 1) & (2**64 - 1))
        step = b.astype(np.uint64) | np.uint64(1)
        for i in range(self.k):
            z = x + step * np.uint64(i)
            z = (z ^ (z >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            yield ((z ^ (z >> np.uint64(29))) & np.uint64(self.bits - 1)).astype(np.int64)

    def has(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), dtype=bool)
        for p in self._places(a, b):
            out &= (self.words[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
        return out


def passes(levels: Sequence[Level], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact for keys of the universe: listed if the first level that misses has an odd number, or none misses and their count is odd."""
    out = np.zeros(len(a), dtype=bool)
    open_ = np.arange(len(a))
    for n, level in enumerate(levels):
        hit = level.has(a[open_], b[open_])
        out[open_[~hit]] = n % 2 == 1
        open_ = open_[hit]
    out[open_] = len(levels) % 2 == 1
    return out


def cascade_bytes(listed: int, universe: int) -> int:
    """An upper bound of the size of all levels."""
    return int(64 + 2 * listed * 1.44 * (math.log2(max(2.0, 2 * universe / max(1, listed))) + 4) / 8 * 2)


def build_cascade(listed: DataFrame, universe: DataFrame, max_bytes: int = 64 << 20) -> list[Level] | None:
    """Both frames have a string column key. None if the cascade would be larger than max_bytes.

    What comes to the driver: the list's hashes, and the universe's false positives at level 0, which the
    rate keeps below the list's size."""
    keys = listed.where(F.col("key").isNotNull()).select("key").distinct()
    n = keys.count()
    if not n:
        return []
    others = universe.where(F.col("key").isNotNull()).select("key").distinct().join(keys, "key", "left_anti")
    others = others.select(hashes(F.col("key")).alias("h")).select("h.a", "h.b")
    m = others.count()
    if cascade_bytes(n, m) > max_bytes:
        return None
    inside = keys.select(hashes(F.col("key")).alias("h")).select("h.a", "h.b").toPandas().to_numpy(dtype=np.int64).reshape(-1, 2)
    rate = min(0.5, math.sqrt(0.5) * n / max(1, m))
    levels = [Level(inside[:, 0], inside[:, 1], rate, 0)]
    first = others.sparkSession.sparkContext.broadcast(levels[0])

    @F.pandas_udf("boolean")
    def maybe(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(first.value.has(a.to_numpy(), b.to_numpy()))

    outside = others.where(maybe("a", "b")).toPandas().to_numpy(dtype=np.int64).reshape(-1, 2)
    yes, no = outside, inside  # the next level encodes yes; no holds what it must not take
    while len(yes):
        if len(levels) == 64:
            raise ValueError("two different keys have the same 128 hash bits")
        levels.append(Level(yes[:, 0], yes[:, 1], 0.5, len(levels)))
        wrong = levels[-1].has(no[:, 0], no[:, 1])
        yes, no = no[wrong], yes
    return levels


def member_flags(spark: SparkSession, levels: list[Level], keys: Column) -> Column:
    """For an array of keys the array of flags."""
    shared = spark.sparkContext.broadcast(levels)

    @F.pandas_udf("array<boolean>")
    def flags(a: pd.Series, b: pd.Series) -> pd.Series:
        sizes = a.map(len).to_numpy()
        if not sizes.sum():
            return pd.Series([[] for _ in sizes])
        hit = passes(shared.value, np.concatenate(a.to_numpy()).astype(np.int64), np.concatenate(b.to_numpy()).astype(np.int64))
        return pd.Series(np.split(hit, np.cumsum(sizes)[:-1]))

    return flags(F.transform(keys, lambda k: F.xxhash64(k)), F.transform(keys, lambda k: F.xxhash64(F.lit(7), k)))


def listed_by_join(rows: DataFrame, keys: str, listed: DataFrame, out: str) -> DataFrame:
    """For lists beyond the size bound: flags by a shuffled join of the exploded keys; row_key names a row."""
    one = rows.withColumn("row_key", F.monotonically_increasing_id()) if "row_key" not in rows.columns else rows
    hit = (
        one.select("row_key", F.explode(keys).alias("key"))
        .join(listed.select("key").distinct(), "key", "left_semi")
        .groupBy("row_key").agg(F.collect_set("key").alias("hit"))
    )
    return one.join(hit, "row_key", "left").withColumn(out, F.transform(keys, lambda k: F.coalesce(F.array_contains("hit", k), F.lit(False)))).drop("hit", "row_key")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, listed: Sequence[str] | DataFrame = LISTED, url: str = "url") -> DataFrame:
    """Adds host, path, rule and verdict to pages (columns of these names are replaced). The longest rule that fits decides; else a listed host is blocked.

    listed: the domains, or a frame with them in a string column key, which never passes the driver as a whole unless its cascade is within the bound."""
    if any(not p.endswith("/") or not p.startswith("/") for _, _, p in rules):
        raise ValueError("a rule's path starts and ends with a slash")
    spark = pages.sparkSession
    depth = max([p.count("/") for _, _, p in rules], default=1)
    rows = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    # the universes are read for each list; they are made once
    distinct_keys = cut(rows.select("host", "path").select(F.explode(candidates(F.col("host"), F.col("path"), depth)).alias("key")).distinct(), "keys")
    distinct_hosts = cut(rows.select("host").distinct().select(F.explode(host_suffixes(F.col("host"))).alias("key")).distinct(), "hosts")
    lists = {
        "allow": [h + p for v, h, p in rules if v == "allow"],
        "block": [h + p for v, h, p in rules if v == "block"],
        "hosts": listed if isinstance(listed, DataFrame) else list(listed),
    }
    rows = rows.withColumns({"_keys": candidates(F.col("host"), F.col("path"), depth), "_hosts": host_suffixes(F.col("host"))})
    for name, keys in lists.items():
        listing = keys.select("key") if isinstance(keys, DataFrame) else spark.createDataFrame([(k,) for k in keys], "key string")
        levels = build_cascade(listing, distinct_hosts if name == "hosts" else distinct_keys)
        column = "_hosts" if name == "hosts" else "_keys"
        if levels is None:
            rows = listed_by_join(rows, column, listing, f"_{name}_in")
        else:
            rows = rows.withColumn(f"_{name}_in", member_flags(spark, levels, F.col(column)))
    fits = F.expr("transform(filter(arrays_zip(_keys, _allow_in, _block_in), x -> x._allow_in or x._block_in), x -> struct(length(x._keys) as n, x._block_in as b, x._keys as k))")
    rows = rows.withColumn("_rule", F.array_max(fits))
    return rows.withColumns({
        "rule": F.col("_rule.k"),
        "verdict": F.when(F.col("_rule").isNotNull(), F.when(F.col("_rule.b"), "block").otherwise("allow"))
        .when(F.exists("_hosts_in", lambda x: x), "block").otherwise("allow"),
    }).drop("_keys", "_hosts", "_allow_in", "_block_in", "_hosts_in", "_rule")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


_listed = "|".join(x.replace(".", "[.]") for x in LISTED)
OP9_SQL = f"""
with u as (
  select page_id,
    translate(regexp_extract(coalesce(url,''), '^(?s:.*?)://([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host,
    regexp_extract(coalesce(url,''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) as path
  from pages),
r as (
  select *, case
    when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
    when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
    when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/'
    when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/' end as rule
  from u)
select page_id, host, path, rule,
  case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
       when regexp_matches(host, '(^|[.])({_listed})$') then 'block' else 'allow' end as verdict
from r
"""
