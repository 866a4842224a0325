"""Benchmark decontamination by template canonicalisation.

Texts become sequences of canonical tokens: numbers turn into ``<num>``, a number's unit into
``<unit>``, capitalised words inside a sentence into ``<name>``, everything else into lower-case words.
An item that was re-parameterised (other numbers, names or units) keeps its template. Windows of
``WINDOW`` canonical tokens of the benchmark are hash-joined with those of the documents. Three forms are
joined: the one above, one in which capitalised words are ``<name>`` wherever they stand (what punctuation and
line breaks are around them does not matter), and the lower-case words as they are (case does not matter either).

A document holds an item if an occurrence has at least ``COVER`` of the item's windows and agrees in the
slots: over the window pairs that hold slots, each value of the item's slots must be answered by one value of
the document's in at least ``CONSISTENT`` of the cases (the same number twice in the question is the same
number twice in the copy). Occurrences are the matches at one distance between document and item offset, those at
distances within an item's length of each other (words put in or left out), and all of the document
together, in all forms or in the first one, so that other variants in the document do not spoil one. If ``COVER`` of the windows occur with the
item's own words, nothing else is asked.

Items with fewer tokens than WINDOW are one window of their own length; documents are also cut into
windows of those lengths (fewer than WINDOW different ones). The benchmark's windows are broadcast if
they are at most ``BROADCAST_ROWS``, and joined by shuffling beyond.

Not all windows of a document need to be hashed. In each window of the benchmark the longest two neighbouring words that are
no slots in any form are its key (the longest word, where no two are neighbours); a window that equals it in any form
holds those very words. So only windows around keys are made, and texts without one are done after their words were
hashed once. If the benchmark has windows of slots alone, windows around numbers, units and capitalised words are made
as well. Up to ``KEYS`` keys are part of the plan; beyond,
all windows of all documents are made, with the same result.

Only array functions and joins are used. Document windows are hashed inside one row and exploded
straight into the join, so no more than the matches are shuffled.

Defined results: null and empty texts hold nothing; an empty benchmark contaminates nothing; repeated
rows are judged alike, and rows that share an id (or have none) together; ``clean`` judges rows without an id by their
texts; items whose text has no token are ignored; extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, text_or_empty

WINDOW, COVER, CONSISTENT, BROADCAST_ROWS, KEYS = 8, 0.6, 0.8, 500_000, 50_000
UNITS = ("kg", "g", "mg", "km", "m", "cm", "mm", "l", "ml", "s", "ms", "h", "hr", "hrs", "hour", "hours", "min", "minutes", "seconds", "day", "days", "week", "weeks", "year", "years",
         "mile", "miles", "mph", "kmh", "ft", "feet", "inch", "inches", "lb", "lbs", "pound", "pounds", "dollar", "dollars", "euro", "euros", "usd", "eur", "percent", "degree", "degrees")


def raw_tokens(text: Column) -> Column:
    """Words with the sign that ends a sentence kept as a token of its own, and numbers whole."""
    return F.regexp_extract_all(text, F.lit(r"\d+(?:[.,:/]\d+)*|[\p{L}\p{M}]+|[.!?\n]+"), F.lit(0))


def tokens(text: Column) -> Column:
    """The words and numbers of raw_tokens()."""
    return F.regexp_extract_all(text, F.lit(r"\d+(?:[.,:/]\d+)*|[\p{L}\p{M}]+"), F.lit(0))


def with_template(df: DataFrame, text: Column) -> DataFrame:
    """Adds _k, hashes of canonical tokens, and _v, the slots' values (null where a token is no slot)."""
    ends = r"^[.!?\n]"
    units = ",".join(f"'{u}'" for u in UNITS)
    return (
        df.withColumn("_r", raw_tokens(text))
        .withColumn("_r", F.expr(
            f"filter(transform(_r, (x, i) -> named_struct('w', lower(x), 'h', xxhash64(lower(x)), 'num', x rlike '^[0-9]', 'end', x rlike '{ends}', 'name', x rlike '^\\\\p{{Lu}}[\\\\p{{L}}\\\\p{{M}}]*\\\\p{{Ll}}',"
            " 'first', i = 0 or get(_r, i - 1) rlike '" + ends + "', 'after', i > 0 and get(_r, i - 1) rlike '^[0-9]')), t -> not t.end)".replace("\n", "\\n")))
        .withColumn("_k", F.expr(f"transform(_r, t -> case when t.num then 1 when t.after and t.w in ({units}) then 2 when t.name and not t.first then 3 else t.h end)"))
        .withColumn("_b", F.expr(f"transform(_r, (t, i) -> case when t.num then 1 when get(_r, i - 1).num and t.w in ({units}) then 2 when t.name then 3 else t.h end)"))
        .withColumn("_v", F.expr("transform(_b, (b, i) -> if(b in (1, 2, 3), get(_r, i).h, cast(null as bigint)))"))
        .withColumn("_p", F.col("_r.h"))
        .withColumn("_n", F.expr("transform(_r, t -> length(t.w))"))
        .drop("_r")
    )


def windows(lengths: list[int]) -> Column:
    """Structs (w, at) of the hashes of all windows of these lengths that begin at the places _s, in the three forms."""
    parts = [
        F.expr(f"transform(filter(_s, i -> i <= size(_k) - {n - 1}), i -> named_struct('w', xxhash64({salt}, slice({of}, i, {n})), 'at', i, 'len', {n}))")
        for n in lengths for of, salt in (("_k", n), ("_b", n), ("_p", -n))
    ]
    return F.concat(*parts)


PAIR = "shiftleft({0}, 1) ^ {1}"


def keys_of(items: DataFrame, most: int = KEYS) -> dict[str, list[int]] | None:
    """The hashes of the windows' keys: pair, word and bare (windows that have none); None if there are more than most."""
    plain = "get(_b, {0} - 1) not in (1, 2, 3)"
    pair = f"if(j < i + _len - 1 and {plain.format('j')} and {plain.format('j + 1')}, named_struct('k', 2, 'n', get(_n, j - 1) + get(_n, j), 'h', {PAIR.format('get(_p, j - 1)', 'get(_p, j)')}), named_struct('k', 0, 'n', 0, 'h', get(_p, j - 1)))"
    word = f"if({plain.format('j')}, named_struct('k', 1, 'n', get(_n, j - 1), 'h', get(_p, j - 1)), named_struct('k', 0, 'n', 0, 'h', get(_p, j - 1)))"
    places = "sequence(i, i + _len - 1)"
    best = F.expr(f"transform(sequence(1, size(_k) - _len + 1), i -> array_max(concat(transform({places}, j -> {pair}), transform({places}, j -> {word}))))")
    found = items.select(F.explode(best).alias("w")).select("w.h", "w.k").distinct().limit(most + 1).collect()
    return None if len(found) > most else {kind: sorted({r["h"] for r in found if r["k"] == k}) for k, kind in enumerate(("bare", "word", "pair"))}


def with_starts(docs: DataFrame, keys: dict[str, list[int]] | None, window: int) -> DataFrame:
    """docs (_id, _t) with _s, the places where windows begin that can be the benchmark's, and without texts that have none."""
    rows = docs.withColumn("_w", tokens(F.col("_t")))
    if keys is None:
        return rows.where(F.size("_w") > 0).withColumn("_s", F.expr("sequence(1, size(_w))")).drop("_w")
    units = ",".join(f"'{u}'" for u in UNITS)
    at = "filter(transform({0}, (x, i) -> if({1}, i + 1, 0)), i -> i > 0)"
    listed = lambda kind: f"x in ({','.join(f'{h}L' for h in keys[kind])})"
    parts = []
    if keys["pair"]:
        parts.append(at.format(f"zip_with(h, slice(h, 2, size(h)), (a, b) -> {PAIR.format('a', 'b')})", listed("pair")))
    if keys["word"] or keys["bare"]:  # the words of bare windows are keys of the form that has no slots
        parts.append(at.format("h", " or ".join(listed(k) for k in ("word", "bare") if keys[k])))
    if keys["bare"]:
        parts.append(at.format("_w", f"x rlike '^[0-9\\\\p{{Lu}}]' or lower(x) in ({units})"))
    if not parts:
        return docs.where("false").withColumn("_s", F.array(F.lit(1)))
    near = F.expr(f"get(transform(array(transform(_w, x -> xxhash64(lower(x)))), h -> concat({', '.join(parts)})), 0)")
    starts = F.expr(f"array_distinct(flatten(transform(_at, i -> sequence(greatest(1, i - {window - 1}), i))))")
    return rows.withColumn("_at", near).where(F.size("_at") > 0).withColumn("_s", starts).drop("_w", "_at")


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", window: int = WINDOW, cover: float = COVER, files: int | None = None) -> DataFrame:
    """(key, item_id, n_windows, n_matched, n_slots, consistency) of the documents that hold an item, the last two of the occurrence that agrees best.

    files: the matches are written in no more than these, as in cut()."""
    items = with_template(benchmark.select("item_id", text_or_empty().alias("_t")), F.col("_t")).drop("_t").where(F.size("_k") > 0)
    items = items.withColumn("_len", F.least(F.size("_k"), F.lit(window)))
    lengths = sorted(r[0] for r in items.select("_len").distinct().collect()) or [window]
    own = F.expr(
        "transform(sequence(1, size(_k) - _len + 1), i -> named_struct('id', xxhash64(_len, slice(_k, i, _len)), 'at', i, 'forms', array_distinct(array("
        "named_struct('w', xxhash64(_len, slice(_k, i, _len)), 'exact', false), named_struct('w', xxhash64(_len, slice(_b, i, _len)), 'exact', false), named_struct('w', xxhash64(-_len, slice(_p, i, _len)), 'exact', true)))))")
    places = items.select("item_id", F.size("_k").alias("_size"), (F.size("_k") - F.col("_len") + 1).alias("_places"), "_len", F.explode(own).alias("g"), "_v", F.expr("transform(_v, (v, i) -> if(get(_k, i) in (1, 2, 3), v, cast(null as bigint)))").alias("_o"))
    grams = places.select("item_id", "_size", "_places", F.col("g.id").alias("_iw"), F.col("g.at").alias("_iat"), F.expr("slice(_v, g.at, _len)").alias("_iv"), F.expr("slice(_o, g.at, _len)").alias("_io"), F.explode("g.forms").alias("f"))
    grams = grams.select("*", F.col("f.w").alias("_w"), F.col("f.exact").alias("_exact"), (F.col("f.w") == F.col("_iw")).alias("_first")).drop("f")
    total = grams.groupBy("item_id").agg(F.countDistinct("_iw").alias("n_windows"))
    n = grams.count()
    small = (lambda f: F.broadcast(f)) if n <= BROADCAST_ROWS else (lambda f: f)
    near = with_starts(docs.select(F.col(key).alias("_id"), text_or_empty().alias("_t")), keys_of(items), window)
    mine = with_template(near, F.col("_t"))
    found = cut(  # the matches, which the sums below read
        mine.select("_id", F.explode(windows(lengths)).alias("g"), "_v")
        .select("_id", F.col("g.w").alias("_w"), F.col("g.at").alias("_dat"), F.expr("slice(_v, g.at, g.len)").alias("_dv"))
        .join(small(grams), "_w"), "matches", files)
    once = found.groupBy("_id", "item_id", "_size", "_places", "_iw", "_iat", "_iv", "_io", "_dat", "_dv").agg(F.max("_exact").alias("_exact"), F.max("_first").alias("_first"))
    far = F.col("_dat") - F.col("_iat")
    groups = [(0, F.lit(0)), (1, far), (2, F.floor(far / F.col("_size"))), (3, F.floor((far + F.col("_size") / 2) / F.col("_size"))), (4, F.when(F.col("_first"), F.lit(0)))]
    # of equal rows (repeated documents) each match counts once
    placed = once.withColumn("_g", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), g.cast("bigint").alias("no")) for k, g in groups]))).where("_g.no is not null")
    by = ["_id", "item_id", "_g"]
    per = placed.groupBy(*by, "_places").agg(F.countDistinct("_iw").alias("n_matched"), F.countDistinct("_iat").alias("n_at"), F.countDistinct(F.when(F.col("_exact"), F.col("_iat"))).alias("n_exact"))
    pairs = (
        placed.select(*by, F.explode(F.arrays_zip(F.when(F.col("_g.kind") == 4, F.col("_io")).otherwise(F.col("_iv")).alias("_iv"), "_dv")).alias("p"))
        .where("p._iv is not null and p._dv is not null")
        .groupBy(*by, F.col("p._iv").alias("iv"), F.col("p._dv").alias("dv")).agg(F.count(F.lit(1)).alias("c"))
        .groupBy(*by, "iv").agg(F.max("c").alias("best"), F.sum("c").alias("all"))
        .groupBy(*by).agg(F.sum("all").alias("n_slots"), (F.sum("best") / F.sum("all")).alias("consistency"))
    )
    exact = F.col("n_exact") >= cover * F.col("_places")
    enough = F.when(F.col("_g.kind").isin(0, 4), F.col("n_matched") >= cover * F.col("n_windows")).otherwise(F.col("n_at") >= cover * F.col("_places"))
    judged = (
        per.join(small(total), "item_id").join(pairs, by, "left").where(enough | exact)
        .withColumn("consistency", F.when(exact, 1.0).otherwise(F.coalesce("consistency", F.lit(1.0)))).where(F.col("consistency") >= CONSISTENT)
    )
    best = judged.groupBy("_id", "item_id", "n_windows").agg(
        F.max("n_matched").alias("n_matched"), F.max(F.struct("consistency", F.coalesce("n_slots", F.lit(0)).cast("bigint").alias("n_slots"))).alias("b"))
    return best.select(F.col("_id").alias(key), "item_id", "n_windows", "n_matched", F.col("b.n_slots").alias("n_slots"), F.col("b.consistency").alias("consistency"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", files: int | None = None) -> DataFrame:
    """docs without the contaminated ones."""
    own = F.coalesce(F.concat(F.lit("i"), F.col(key).cast("string")), F.concat(F.lit("t"), F.xxhash64(text_or_empty()).cast("string")))
    bad = contaminated(docs.select(own.alias("_own"), "text"), benchmark, "_own", files=files).select(F.col("_own").alias("_bad")).distinct()
    return docs.join(bad, own == F.col("_bad"), "left_anti")
