"""Document fingerprints: SpotSigs.

A spot signature starts at an anchor (a very common word) and chains the next ``CHAIN`` content words
within ``REACH`` words. Words that no anchor reaches, as in tables and lists (none is among the ``REACH``
words before them), start a chain of words themselves. The rule is the same for all texts and looks at a word's
surroundings only, so that a small edit changes few signatures. A document's fingerprint is its set of signatures (32-bit hashes, sorted, eight
hex digits each). Fingerprints are compared by Jaccard similarity. ``similar_pairs`` partitions the sets by
length so that similar sets lie in the same or in the next partition, looks them up by their rarest
signatures (the prefix that any set as similar must meet), prunes by length and verifies.

``with_edits`` puts beside every document the one that follows by id, and a text whose last quarter is
the beginning of that one. Only ids, text hashes and lengths are ordered: they are dealt into ranges of near
equal size, whatever the ids are, and written once; a range's last row is followed by the first of the next
range (one row a range). Each text is then asked for just the characters that its predecessor needs; texts
are shuffled once, by id, and never sorted or held in a window.

Only array functions and joins are used. Defined results: a null text is empty; an empty text has an
empty fingerprint, two empty fingerprints are alike (1.0) and an empty and another one are not (0.0); a
text with words but no complete chain has one signature, the hash of all its words, and a text without
words the hash of the text; rows that share an id follow each other by their texts' hashes; equal rows (id and
text) count as one and get equal results; null ids come first; the last document is followed by the first, and so
a single document by itself; ids may be of any type that can be ordered; extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, text_or_empty

CHAIN, REACH, RANGE = 2, 12, 16_384
#: Very common words of the four languages.
COMMON = ("the", "a", "an", "is", "was", "that", "der", "die", "das", "ein", "ist", "le", "la", "les", "un", "une", "est", "el", "los", "las", "una", "es",
    "of", "to", "and", "in", "for", "on", "with", "by", "as", "at", "it", "this", "be", "are", "from", "or",
    "und", "den", "dem", "des", "von", "zu", "mit", "sich", "nicht", "auf", "für", "im", "eine",
    "de", "du", "et", "que", "qui", "en", "dans", "sur", "par", "pour", "au", "avec",
    "y", "del", "al", "se", "con", "su", "por", "para", "como",
)


def let(value: Column, body) -> Column:
    """body(value), where value is computed once for a row. Without it the optimizer may copy a value's expression into a
    lambda that uses it, which then computes it for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def signatures(text: Column) -> Column:
    """The sorted distinct signatures (array<int>) of a text."""
    def spots(t: Column, h: Column, at: Column) -> Column:
        chains = F.transform(at, lambda i: F.struct(F.get(t, i).alias("a"), F.filter(F.slice(h, i + 2, REACH), lambda x: x.isNotNull()).alias("c")))
        return F.transform(F.filter(chains, lambda s: F.size(s["c"]) >= CHAIN), lambda s: F.hash(s["a"], F.slice(s["c"], 1, CHAIN)))

    def far(t: Column, at: Column) -> Column:
        """Of the words that no anchor reaches: from the text's start or REACH + 1 words after an anchor to the next one."""
        ends = F.concat(at, F.array(F.size(t)))
        runs = F.transform(ends, lambda e, k: F.struct(F.when(k == 0, 0).otherwise(F.get(at, k - 1) + REACH + 1).alias("lo"), (F.least(e, F.size(t) - CHAIN) - 1).alias("hi")))
        places = F.flatten(F.transform(F.filter(runs, lambda r: r["lo"] <= r["hi"]), lambda r: F.sequence(r["lo"], r["hi"])))
        return F.transform(places, lambda i: F.hash(F.slice(t, i + 1, CHAIN + 1)))

    def chosen(t: Column, h: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: F.get(h, i).isNull())
        both = let(at, lambda p: F.concat(spots(t, h, p), far(t, p)))
        return let(both, lambda s: F.when(F.size(s) > 0, s).otherwise(F.array(F.hash(t))))

    tokens = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    hashed = lambda t: F.transform(t, lambda w: F.when(~w.isin(*COMMON), F.xxhash64(w)))
    found = let(tokens, lambda t: F.when(F.size(t) > 0, let(hashed(t), lambda h: F.array_sort(F.array_distinct(chosen(t, h))))))
    return F.when(text == "", F.array().cast("array<int>")).otherwise(F.coalesce(found, F.array(F.hash(text))))


def with_signatures(df: DataFrame, text: Column, out: str) -> DataFrame:
    return df.withColumn(out, signatures(text))


def fingerprint(signatures: str) -> Column:
    return F.array_join(F.transform(signatures, lambda x: F.lpad(F.lower(F.hex(x.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity; each set is computed once, wherever it comes from."""
    def of(x: Column, y: Column) -> Column:
        return let(F.size(F.array_intersect(x, y)), lambda both: F.when(F.size(x) + F.size(y) == 0, 1.0).otherwise(both / (F.size(x) + F.size(y) - both)))

    return let(F.col(a), lambda x: let(F.col(b), lambda y: of(x, y)))


def length_partition(signatures: str, tau: float = 0.8) -> Column:
    """Sets with a Jaccard similarity of tau or more are in the same partition or in neighbouring ones."""
    import math

    return F.floor(F.log(F.greatest(F.size(signatures), F.lit(1)).cast("double")) / math.log(1 / tau)).cast("int")


def successors(texts: DataFrame) -> DataFrame:
    """texts (id, tie, text) -> (id, tie, n, copies, next_id, next_tie) for each distinct (id, tie), in the order of both."""
    rows = texts.groupBy("id", "tie").agg(F.max(F.length("text")).alias("n"), F.count(F.lit(1)).alias("copies"))
    dealt = rows.repartitionByRange(texts.count() // RANGE + 1, F.col("id").asc_nulls_first(), "tie")
    placed = cut(dealt.withColumn("part", F.spark_partition_id()), "order")  # read twice: as written, whatever is run again
    line = Window.partitionBy("part").orderBy(F.col("id").asc_nulls_first(), "tie")
    heads = placed.groupBy("part").agg(F.min(F.struct("id", "tie")).alias("head"))
    parts = Window.orderBy("part")
    after = heads.select(F.col("part").alias("_part"), F.coalesce(F.lead("head").over(parts), F.first("head").over(parts)).alias("_after"))
    nexts = placed.withColumn("_next", F.lead(F.struct("id", "tie")).over(line)).join(after, F.col("part") == F.col("_part"))
    return nexts.withColumn("_next", F.coalesce("_next", "_after")).select("id", "tie", "n", "copies", F.col("_next.id").alias("next_id"), F.col("_next.tie").alias("next_tie"))


def with_next(docs: DataFrame, key: str = "doc_id", share: int | None = None) -> DataFrame:
    """(key, _text, _next_text, _next_sig) for all rows. With a share, _next_text is only as much of the next text as that part of the row's own has (4: a quarter)."""
    texts = docs.select(F.col(key).alias("id"), text_or_empty().alias("text")).withColumn("tie", F.xxhash64("text"))
    order = cut(successors(texts), "successors")
    asked = order.select(F.col("id").alias("_for"), F.col("tie").alias("_for_tie"), F.floor(F.col("n") / (share or 1)).cast("int").alias("_most"), F.col("next_id").alias("_id"), F.col("next_tie").alias("_tie"))
    found = texts.join(asked, F.col("id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")))
    answers = found.select("_for", "_for_tie", (F.substring(F.col("text"), F.lit(1), F.col("_most")) if share else F.col("text")).alias("_next_text"), F.col("text").alias("_whole"))
    answers = with_signatures(answers, F.col("_whole"), "_next_sig").drop("_whole")
    if not order.where("copies > 1").isEmpty():  # equal rows have answered once each
        answers = answers.dropDuplicates(["_for", "_for_tie"])
    return texts.join(answers, F.col("id").eqNullSafe(F.col("_for")) & (F.col("tie") == F.col("_for_tie"))).select(F.col("id").alias(key), F.col("text").alias("_text"), "_next_text", "_next_sig")


def with_edits(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, _text, n_chars, _edited, _sig, _edited_sig, _next_sig) for all rows."""
    n = F.length("_text")
    rows = with_next(docs, key, 4).withColumn("n_chars", n.cast("bigint")).withColumn(
        "_edited", F.concat(F.substring(F.col("_text"), F.lit(1), n - F.floor(n / 4).cast("int")), F.col("_next_text")))
    return with_signatures(with_signatures(rows, F.col("_text"), "_sig"), F.col("_edited"), "_edited_sig")


def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edits(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_chars", F.sha2(F.encode("_edited", "UTF-8"), 256).alias("edited_sha256"),
        fingerprint("_sig").alias("fingerprint"), fingerprint("_edited_sig").alias("edited_fingerprint"),
        likeness("_sig", "_edited_sig").alias("near_edited"), likeness("_sig", "_next_sig").alias("near_next"),
        length_partition("_sig").alias("length_partition"),
    )


def similar_pairs(docs: DataFrame, tau: float = 0.8, key: str = "doc_id") -> DataFrame:
    """(left, right, likeness): pairs of different fingerprints, each by the smallest id that has it."""
    sigs = with_signatures(docs.select(F.col(key), text_or_empty().alias("_text")), F.col("_text"), "_sig").where(F.size("_sig") > 0)
    sets = sigs.groupBy("_sig").agg(F.min(key).alias("id")).withColumn("part", length_partition("_sig", tau))
    rare = sets.select("id", "part", F.size("_sig").alias("n"), F.explode("_sig").alias("s"))
    often = rare.groupBy("s").agg(F.count(F.lit(1)).alias("df"))
    place = Window.partitionBy("id").orderBy("df", "s")
    prefix = rare.join(often, "s").withColumn("r", F.row_number().over(place)).where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * tau) + 1).where("df > 1")
    left = prefix.select("s", "n", F.col("id").alias("left"), F.explode(F.array("part", F.col("part") + 1)).alias("meet"))
    right = prefix.select("s", F.col("n").alias("m"), F.col("id").alias("right"), F.col("part").alias("meet"))
    close = left.join(right, ["s", "meet"]).where(((F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("left") < F.col("right")))) | ((F.col("n") > F.col("m")) & (F.col("left") != F.col("right"))))
    close = close.where(F.least("n", "m") >= tau * F.greatest("n", "m")).select(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right")).distinct()
    a, b = sets.select(F.col("id").alias("left"), F.col("_sig").alias("_a")), sets.select(F.col("id").alias("right"), F.col("_sig").alias("_b"))
    return close.join(a, "left").join(b, "right").select("left", "right", likeness("_a", "_b").alias("likeness")).where(F.col("likeness") >= tau)
