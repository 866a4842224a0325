"""The corpus operators against brute force, and on rows that are unusual."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from compare import assert_same, connection
from pyspark.sql import functions as F

from textsieve.llm import catalog, common, components, decontaminate, line_dedup, near_dedup, quality, sentencepieces, sharding, spotsigs, suffix_dedup, url_filter, warc

SF = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string"


def odd_rows():
    """Null and empty texts, a null id, ties, repeated rows and a long text."""
    word = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rng = random.Random(3)
    base = " ".join(rng.choice(word) + str(rng.randint(0, 99)) for _ in range(80))
    return [(1, base), (2, base), (2, base), (3, None), (4, ""), (5, "x"), (6, base + " tail of another kind"), (None, base), (7, "line one is quite long\n" * 400), (8, " ".join(rng.choice(word) for _ in range(3000)))]


def wide(spark, rows):
    """With extra columns whose names the operators use themselves."""
    return spark.createDataFrame(rows, DOC).select("*", *[F.lit(i).alias(n) for i, n in enumerate(("id", "n", "h", "size", "label"))])


@pytest.mark.parametrize("name", ["op2_line_dedup", "op9_url_filter"])
def test_sql(spark, name):
    assert_same(catalog.queries()[name](spark, SF), catalog.oracles()[name], connection(SF))


# ---- near duplicates -------------------------------------------------------------------------------

def shingle_set(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_classes(rows):
    ids = sorted({i for i, _ in rows})
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = {i: shingle_set(t) for i, t in rows}
    for a, b in itertools.combinations(ids, 2):
        u = len(sets[a] | sets[b])
        if (u == 0) or len(sets[a] & sets[b]) >= 0.8 * u:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_dedup(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r.class_id for r in near_dedup.op1_near_dedup(spark, SF).collect()}
    assert got == brute_classes(rows)


def test_near_dedup_odd_rows(spark):
    got = [(r.doc_id, r.class_id) for r in near_dedup.classes(wide(spark, odd_rows())).collect()]
    assert len(got) == len(odd_rows())
    assert (None, None) in got
    by = dict(got)
    assert by[1] == by[2] == by[6] == 1 and by[3] == by[4] == 3 and by[5] == 5 and by[8] == 8
    assert near_dedup.classes(spark.createDataFrame([], DOC)).count() == 0


def test_large_bucket_keeps_links(spark):
    """A group of more near copies than a small bucket has, no two texts equal."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(150):
        w = list(base)
        w[rng.randrange(300)] = f"z{i}"
        rows.append((i, " ".join(w)))
    assert {r.class_id for r in near_dedup.classes(spark.createDataFrame(rows, DOC)).collect()} == {0}


def test_large_bucket_keeps_unrelated_pairs(spark):
    """A family of 162 texts of similarity 0.77, of which 80 pairs have 0.81; most of the buckets that a pair shares hold more texts than a small one."""
    fresh = iter(range(10**6))
    words = lambda n: [f"w{next(fresh)}" for _ in range(n)]
    core, rows = words(870), []
    for i in range(82):
        both = words(25)
        rows += [(len(rows) + j, " ".join(core + both + words(105))) for j in range(1 if i < 2 else 2)]
    want = brute_classes(rows)
    assert len(set(want.values())) == 82
    assert {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(rows, DOC)).collect()} == want


def test_repeated_paragraphs_keep_near_copies(spark):
    """Pairs of set similarity above 0.8, of which one text has half of the shingles 50 times."""
    rng = random.Random(6)
    rows = []
    for i in range(0, 200, 2):
        often, once = ([f"{k}{i}n{j}" for j in range(100)] for k in "pq")
        other = list(once)
        for j in (15, 45, 75):
            other[j] = f"z{rng.random()}"
        rows += [(i, " ".join(often + once)), (i + 1, " ".join(often * 50 + other))]
    want = brute_classes(rows)
    assert all(want[i + 1] == i for i in range(0, 200, 2))
    assert {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(rows, DOC)).collect()} == want


def test_registers_agree_with_similarity():
    """The share of equal registers estimates the probability Jaccard similarity of weighted sets."""
    rng = np.random.default_rng(5)
    e = rng.integers(0, 2**63, 60).astype(np.uint64)
    w = rng.uniform(0.5, 3, (2, 60))
    w[0, :15], w[1, 45:] = 0, 0
    doc = np.repeat([0, 1], [45, 45])
    held = near_dedup.prob_min_hash(doc, np.concatenate([e[15:], e[:45]]), np.concatenate([w[0, 15:], w[1, :45]]), 2, registers=20_000)
    want = sum(1 / sum(max(w[0, j] / w[0, i], w[1, j] / w[1, i]) for j in range(60)) for i in range(15, 45))
    assert abs((held[0] == held[1]).mean() - want) < 0.02


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 99), (7, 7)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 99: 99, 100: 99, 101: 99}


# ---- lines ---------------------------------------------------------------------------------------

def test_line_dedup_spans(spark):
    long = "One two three four five six seven eight."
    rows = [(1, f"{long}\nShort. Yes!\nÜnique line number two here it is well"), (2, f"x\n{long.upper()}  Short. Yes!  And this sentence is new in every one of its words"), (3, long), (4, None), (5, ""), (6, "Ha ho. " * 50), (7, "Short. Yes!")]
    got = {r.doc_id: r for r in line_dedup.dedup(wide(spark, rows)).collect()}
    assert got[1].n_removed == 0 and got[1].text == rows[0][1]
    assert got[2].removed == "2-57" and rows[1][1][2:57] == long.upper() + "  Short. Yes!  " and got[2].text == "x\nAnd this sentence is new in every one of its words"
    assert got[3].text == "" and got[3].n_removed == 1 and got[4].text is None and got[5].n_units == 0
    assert got[6].text == "Ha ho. " * 4 and got[7].text == "Short. Yes!"


def test_line_dedup_finds_passages_inside_lines(spark):
    rng = random.Random(8)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    passage = f"{words(9)}. {words(3)}. {words(12)}, {words(4)}! {words(2)}. {words(30)}."
    rows = [(i, f"{words(20)}. {passage} {words(15)}.") for i in range(6)]
    got = {r.doc_id: r.text for r in line_dedup.dedup(spark.createDataFrame(rows, DOC)).collect()}
    assert passage in got[0] and all(passage not in got[i] and len(got[i].split()) == 35 for i in range(1, 6))


def test_line_dedup_short_runs_stay(spark):
    """With a least run, lines that many documents share stay and passages go."""
    line = "released under the license of this work and of no other"
    passage = ". ".join(" ".join(f"w{i}x{j}" for j in range(9)) for i in range(4)) + "."
    rows = [(i, f"own words {i} alone\n{line}\nmore own words {i}\n{passage}") for i in range(4)]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup(spark.createDataFrame(rows, DOC), min_run=line_dedup.MIN_RUN).collect()}
    assert got[0] == (rows[0][1], 0) and all(got[i] == (f"own words {i} alone\n{line}\nmore own words {i}\n", 4) for i in range(1, 4))


def test_line_dedup_odd_rows(spark):
    assert line_dedup.dedup(spark.createDataFrame([], DOC)).count() == 0
    assert line_dedup.dedup(wide(spark, odd_rows())).count() == len(odd_rows())


def test_near_dedup_writes_no_file_for_each_partition(spark, monkeypatch):
    """With 40 partitions that Spark does not join, keys, pairs and labels have as many files as there are cores; the sets, which are wide, have more."""
    made = []

    def counting(cut):
        def counted(df, tag="stage", *files):
            out = cut(df, tag, *files)
            made.append((tag, len(out.inputFiles())))
            return out

        return counted

    for module in (near_dedup, components):
        monkeypatch.setattr(module, "cut", counting(module.cut))
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    rng = random.Random(12)
    rows = []
    for i in range(150):
        words = [str(rng.random()) for _ in range(60)]
        rows += [(3 * i, " ".join(words)), (3 * i + 1, " ".join(words[:59])), (3 * i + 2, " ".join(words[1:]))]
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(rows, DOC)).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == {i: i // 3 * 3 for i, _ in rows}
    assert {t for t, _ in made} >= {"first", "buckets", "tested", "links", "labels"}
    assert max(n for t, n in made if t != "sets") <= spark.sparkContext.defaultParallelism


# ---- suffix arrays -------------------------------------------------------------------------------

def brute_repeats(rows):
    seen, out = set(), {}
    for i, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s:s + 100]
            if w in seen:
                gone[s:s + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), len(b) - len(kept), sum(1 for q in range(len(b)) if gone[q] and (not q or not gone[q - 1])), hashlib.sha256(kept).hexdigest())
    return out


def check_suffix(spark, rows):
    made = suffix_dedup.dedup(spark.createDataFrame(rows, DOC))
    got = {r.doc_id: (len((r.text or "").encode()), len((r.text or "").encode()) - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in made.collect()}
    assert got == brute_repeats(rows)


def test_suffix_dedup(spark):
    want = brute_repeats([(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()])
    assert {r[0]: tuple(r[1:]) for r in suffix_dedup.op3_suffix_dedup(spark, SF).collect()} == want


@pytest.mark.parametrize("limits", [{}, {"HOT": 4, "CHUNK": 2000, "SAMPLE": 1, "COMMON": 3}])
def test_suffix_dedup_periods_and_hot_passages(spark, monkeypatch, limits):
    """With the usual limits, and with so low ones that anchors count as common, keys are split and cut, and runs are merged."""
    for k, v in limits.items():
        monkeypatch.setattr(suffix_dedup, k, v)
    rng = random.Random(2)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = noise(260)
    rows = [(0, "a" * 700), (1, "ab" * 300), (2, ""), (3, None), (4, "é" * 120)]
    rows += [(5 + i, noise(rng.randint(0, 150)) + passage[rng.randint(0, 60):] + noise(40)) for i in range(120)]
    rows += [(500 + i, passage[:130] + f"{i % 7}" * 3 + passage[130:]) for i in range(90)]
    check_suffix(spark, rows)


def test_suffix_dedup_odd_rows(spark):
    made = suffix_dedup.dedup(wide(spark, odd_rows())).collect()
    assert len(made) == len(odd_rows())
    assert {bytes(r.kept) for r in made if r.doc_id == 2} == {b""}
    assert suffix_dedup.dedup(spark.createDataFrame([], DOC)).count() == 0


def test_anchors_of_long_texts(monkeypatch):
    """A text of more than 2^24 bytes; views give the anchors that one view gives."""
    rng = np.random.default_rng(4)
    data = rng.integers(97, 101, (1 << 24) + 500).astype(np.uint8)
    t, _, lo, hi = suffix_dedup.anchors(data, np.array([len(data)]))
    assert not t.any() and lo[0] == 0 and hi[-1] == len(data) - 100 and (lo[1:] == hi[:-1] + 1).all() and (hi - lo < 69).all()
    data, ends = data[:9000], np.array([0, 50, 3100, 3100, 3199, 8990, 9000])
    data[4000:4600] = 97
    whole = suffix_dedup.anchors(data, ends)
    for view in (70, 331, 1000):
        monkeypatch.setattr(suffix_dedup, "VIEW", view)
        assert all((x == y).all() for x, y in zip(whole, suffix_dedup.anchors(data, ends), strict=True))


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array(seed):
    rng = np.random.default_rng(seed)
    data = rng.integers(0, 3, 3000).astype(np.uint8)
    data[1500:1900] = data[200:600]
    data[2000:2600] = 1
    order, rank, words = suffix_dedup.suffix_array(data)
    raw = data.tobytes()
    keys = [raw[i:i + 100] for i in order]
    assert keys == sorted(keys)
    shared = suffix_dedup.common_prefixes(order, rank, words, lanes=7)
    for t in range(1, len(order)):
        a, b = raw[order[t - 1]:order[t - 1] + 100], raw[order[t]:order[t] + 100]
        k = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
        assert shared[t] == k or (k == min(len(a), len(b)) < 100)


@pytest.mark.parametrize("ranks", [1 << 21, 1])
def test_suffixes_are_sorted_no_deeper_than_strings_are_long(monkeypatch, ranks):
    """Equal ranks are equal strings of 100 bytes, whether keys have three ranks or two."""
    monkeypatch.setattr(suffix_dedup, "RANKS", ranks, raising=False)
    rng = np.random.default_rng(9)
    data = rng.integers(97, 123, 4000).astype(np.uint8)
    data[1000:1110], data[2000:2300], data[3000:3400] = data[:110], data[300:600], 97
    order, rank, _ = suffix_dedup.suffix_array(data)
    raw = data.tobytes()
    first = {}
    for slot, i in enumerate(order.tolist()):
        first.setdefault(raw[i:i + 100], slot)
    assert [raw[i:i + 100] for i in order] == sorted(raw[i:i + 100] for i in range(len(raw)))
    assert rank.tolist() == [first[raw[i:i + 100]] for i in range(len(raw))]


def test_shards_are_worked_off_in_batches_that_stay_in_cache():
    """Small keys share a batch of about 2^18 bytes; a larger key is not cut for that."""
    rng = np.random.default_rng(10)
    made = [(k, False, k, 0, 0, rng.integers(97, 123, n).astype(np.uint8).tobytes()) for k, n in enumerate([100_000] * 8 + [900_000])]
    batch = pa.RecordBatch.from_pylist([dict(zip(("key", "hot", "id", "h", "lo", "piece"), r, strict=True)) for r in made])
    assert len(list(suffix_dedup._shard(iter([batch])))) == 3


def test_first_occurrences_travel_packed():
    """A split passage's strings are many more than its rows."""
    rng = random.Random(3)
    text = bytes(rng.randrange(97, 123) for _ in range(20_000))
    made = suffix_dedup._chunk([(7, True, 1, 0, 0, text), (7, True, None, 0, 5, text[:300])])
    rows = made.to_pylist()
    packed = [r for r in rows if r["bucket"] is not None]
    places = {(i, lo): r["strings"][k * 100:(k + 1) * 100] for r in packed for k, (i, lo) in enumerate(zip(r["ids"], r["los"], strict=True))}
    want = {(None, 5 + x): text[x:x + 100] for x in range(201)} | {(1, x): text[x:x + 100] for x in range(201, len(text) - 99)}
    assert places == want and len(packed) <= suffix_dedup.BUCKETS
    assert [(r["id"], r["lo"], r["hi"]) for r in rows if r["bucket"] is None] == [(1, 0, 300)]


def test_merge_runs():
    rng = random.Random(1)
    runs = [sorted({bytes([rng.randint(0, 5)]): (True, r, 0, rng.randint(0, 99)) for _ in range(4)}.items()) for r in range(7)]
    merged, gone = suffix_dedup.merge_runs([list(r) for r in runs])
    best = {}
    for run in runs:
        for s, p in run:
            best[s] = min(best.get(s, p), p)
    assert merged == sorted(best.items()) and len(gone) == sum(map(len, runs)) - len(best)


# ---- quality -------------------------------------------------------------------------------------

def test_quality_held_out(spark):
    made = {r.doc_id: r for r in quality.op4_quality(spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    rows = [(made[r.doc_id].predicted, r.quality) for r in labels if made[r.doc_id].held_out]
    assert all(made[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in made)
    good, bad = [p for p, q in rows if q == 1], [p for p, q in rows if q == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.25


def test_quality_density(spark):
    """The column's score equals numpy's."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    train = quality.with_features(docs.join(labels, "doc_id"))
    m = quality.fit(train.select("_x", "quality"))
    rows = quality.with_features(docs).withColumn("s", quality.score(m)).select("_x", "s").collect()
    for r in rows:
        x = np.array(r._x)
        d = [-((m.inverse[c] @ (x - m.mean[c])) ** 2).sum() / 2 - m.logdet[c] for c in (0, 1)]
        z = (d[1] - d[0] + m.odds) / m.temper
        assert math.isclose(r.s, 1 / (1 + math.exp(min(500, max(-500, -z)))), rel_tol=1e-6, abs_tol=1e-12)


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (7, 0), (8, 0), (9, None)], "doc_id bigint, quality int")
    made = quality.classify(wide(spark, odd_rows()), labels)
    assert made.count() == len(odd_rows()) and all(0 <= r.score <= 1 for r in made.collect())
    one = quality.classify(wide(spark, odd_rows()), labels.where("quality = 1"))
    assert {r.score for r in one.collect()} == {0.5}


# ---- shards --------------------------------------------------------------------------------------

def test_sharding(spark):
    rows = sharding.op5_sharding(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000
    total, places = [0] * 40, [[] for _ in range(40)]
    for r in rows:
        total[r.shard] += r["size"]
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places)
    assert max(total) - min(total) <= 0.02 * sum(total) / 40


def test_rebalance_moves_little():
    rng = random.Random(4)
    size = [rng.randint(0, 1000) for _ in range(sharding.SLOTS)]
    before = sharding.rebalance(sharding.first_map(40), size, 40)
    size[17] += 5000
    after = sharding.rebalance(before, size, 40)
    assert sum(a != b for a, b in zip(before, after, strict=True)) < 200
    load = [sum(s for s, k in zip(size, after, strict=True) if k == i) for i in range(40)]
    assert max(load) - min(load) <= 50


def test_sharding_recomputed(spark):
    """Sizes, checksums and places against Python's own; every row's shard is the one the stored map gives its slot."""
    import zlib

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = sharding.op5_sharding(spark, SF).collect()
    assert {r.doc_id: (r["size"], r.text_crc32, r.law, r.grown_shard) for r in rows} == {i: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "bytes", None) for i, t in texts.items()}
    assert len({(r.shard, r.slot) for r in rows}) == len(rows)
    owner = {}
    for r in rows:
        assert owner.setdefault(r.vslot, r.shard) == r.shard


def test_sharding_edits_the_stored_map(spark, tmp_path):
    """Three runs over one store: more documents, then one more shard, then one fewer; only records of edited slots move."""
    store = str(tmp_path / "map")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    more = docs.unionByName(docs.where("doc_id % 10 = 0").select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text"))

    def run(df, shards):
        rows = sharding.assign(df, shards, store=store).collect()
        total, places = [0] * shards, [[] for _ in range(shards)]
        for r in rows:
            total[r.shard] += r["size"]
            places[r.shard].append(r.slot)
        assert all(sorted(p) == list(range(len(p))) for p in places)
        assert max(total) - min(total) <= 0.03 * sum(total) / shards
        return {r.doc_id: r.shard for r in rows}, max(r.map_version for r in rows)

    first, v1 = run(docs, 40)
    again, v2 = run(docs, 40)
    assert first == again and v1 == v2 == 2  # nothing to edit, no new version
    second, v3 = run(more, 40)
    assert v3 == 3 and sum(first[i] != second[i] for i in first) < 0.25 * len(first)
    third, v4 = run(more, 41)
    assert v4 == 4 and set(third.values()) == set(range(41)) and sum(second[i] != third[i] for i in second) < 0.25 * len(second)
    fourth, v5 = run(more, 39)
    assert v5 == 5 and max(fourth.values()) == 38
    assert sharding.last_version(spark, store) == 5 and sharding.load_map(spark, store, 3).count() == sharding.SLOTS


def test_sharding_odd_rows(spark):
    rows = sharding.assign(wide(spark, odd_rows())).collect()
    assert len(rows) == len(odd_rows())
    null = next(r for r in rows if r.doc_id == 3)
    assert (null["size"], null.text_crc32) == (16, 0)
    assert sharding.assign(spark.createDataFrame([], DOC)).count() == 0


# ---- pieces --------------------------------------------------------------------------------------

def test_pieces_match_the_library(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)
    rows = odd_rows() + [(20, "  two  blanks \n\ttab 日本 😀 éé"), (21, "▁ literal"), (22, "abcdefgh" * 500)]
    for r in sentencepieces.encode(wide(spark, rows)).collect():
        assert r.ids == lib.encode(r.text or "")
        assert r.n_ids == len(r.ids) and r.exact == ("▁" not in (r.text or ""))


def test_streaming_commits_early():
    m = sentencepieces.load()
    out, seen = [], 0

    def chars():
        nonlocal seen
        for c in "internationalisation" * 300:
            seen += 1
            yield c

    lag = 0
    for piece in m.stream(chars()):
        out.append(piece)
        lag = max(lag, seen - sum(map(len, out)))
    assert "".join(out) == "internationalisation" * 300 and lag <= 4 * m.longest
    assert [i for p in out for i in m.ids_of(p)] == m.short("internationalisation" * 300)


def test_chunks_are_cut_where_no_piece_goes_on():
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)
    m = sentencepieces.load()
    m.encode("thineverung")
    known, seen = set(m.cache), []
    m.short = lambda part, short=m.short: (seen.append(part), short(part))[1]
    for text in ("thineverung%%%", "2024-01-01T00:11:12.172Z", "日本x語。y", "Des.\nLyret"):
        assert np.frombuffer(m.encode(text), "<i4").tolist() == lib.encode(text)
    assert not known & set(seen) and "▁thineverung%%%" not in seen  # the word is not searched again for what follows it


def test_search_remembers_its_states(monkeypatch):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)
    rng = random.Random(4)
    words = ["".join(rng.choice(("tion", "the", "über", "ing", "é", "x", "日", "12", ").", "_")) for _ in range(rng.randint(1, 30))) for _ in range(300)]
    m, asked = sentencepieces.load(), []

    class Pairs(dict):
        def get(self, key):
            asked.append(key)
            return super().get(key)

    m.pair = Pairs()
    m.short("▁" + "internationalisation" * 20)
    asked.clear()
    assert m.short("▁" + "internationalisation" * 40) == lib.encode("internationalisation" * 40) and not asked  # every place is known
    assert m.chunks(" thineverung.\nLyret  (x") == [" thineverung", ".", "\n", "Lyret", "  (", "x"]
    for most in (1 << 18, 20):  # all are remembered, or are forgotten again and again
        monkeypatch.setattr(sentencepieces, "CACHE", most)
        m = sentencepieces.load()
        for w in words:
            assert np.frombuffer(m.encode(f"{w}  {w}"), "<i4").tolist() == lib.encode(f"{w}  {w}")
        m.short("".join(rng.choices("eaintros", k=5000)))
        assert len(m.steps) <= most and sum(map(len, m.steps.values())) <= 4 * most and len(m.cache) <= most


def test_search_of_any_merges():
    """Small models whose merges are made one after the other: what the search finds is what the merges make."""
    rng = random.Random(6)
    for _ in range(40):
        pieces = [*"ab.", "▁"]
        for _ in range(30):
            new = rng.choice(pieces) + rng.choice(pieces)
            if len(new) <= 6 and new not in pieces and "▁" not in new.lstrip("▁"):
                pieces.append(new)
        m = sentencepieces.Pieces([("<unk>", 0, 2), *[(p, -float(i), 1) for i, p in enumerate(pieces)]], "bpe")
        for _ in range(20):
            text = "".join(rng.choice("ab. d") for _ in range(rng.randint(1, 50)))
            made = m.merges("▁" + text.replace(" ", "▁"))
            assert list(m.stream("▁" + text.replace(" ", "▁"))) == made
            assert np.frombuffer(m.encode(text), "<i4").tolist() == [m.id.get(p, 0) for p in made]


def test_unigram_search():
    m = sentencepieces.Pieces([("<unk>", 0, 2), ("a", -3.0, 1), ("b", -3.0, 1), ("ab", -1.0, 1), ("ba", -0.5, 1), ("aba", -4.0, 1)], "unigram")
    for text in ("abab", "ababa", "bb", "aab" * 30):
        best = {0: (0.0, [])}
        for i in range(1, len(text) + 1):
            best[i] = max(((best[j][0] + m.score[text[j:i]], [*best[j][1], text[j:i]]) for j in range(i) if text[j:i] in m.score), key=lambda x: x[0])
        got = list(m.stream(iter(text)))
        assert math.isclose(sum(m.score[p] for p in got), best[len(text)][0])


# ---- fingerprints --------------------------------------------------------------------------------

def test_spotsigs(spark):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = {r.doc_id: r for r in spotsigs.op7_spotsigs(spark, SF).collect()}
    prints = {}
    for k, (i, t) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        q = len(t) // 4
        assert got[i].edited_sha256 == hashlib.sha256((t[:len(t) - q] + after[:q]).encode()).hexdigest()
        assert prints.setdefault(t, got[i].fingerprint) == got[i].fingerprint
        a, b, c = ({f[j:j + 8] for j in range(0, len(f), 8)} for f in (got[i].fingerprint, got[i].edited_fingerprint, got[docs[(k + 1) % len(docs)][0]].fingerprint))
        assert math.isclose(got[i].near_edited, len(a & b) / len(a | b)) and math.isclose(got[i].near_next, len(a & c) / len(a | c))


def test_spotsigs_near_the_line(spark):
    """30 anchors in 200 words, and five more words at the end; and a list without anchors, of which one word changes."""
    words = [w for i in range(30) for w in ("the", *[f"x{i}y{j}" for j in range(6 if i % 3 else 5)])] + ["tail"] * 10
    base = " ".join(words[:200])
    listed = [f"n{i}" for i in range(100)]
    rows = [(1, base), (2, base + " p q r s u"), (3, " ".join(listed)), (4, " ".join(listed[:50] + ["other"] + listed[51:]))]
    got = {r.doc_id: set(r.s) for r in spotsigs.with_signatures(spark.createDataFrame(rows, DOC), F.col("text"), "s").collect()}
    like = lambda a, b: len(got[a] & got[b]) / len(got[a] | got[b])
    assert like(1, 2) > 0.8 and like(3, 4) > 0.9 and len(got[3]) == 98


def test_spotsigs_ranges(spark, monkeypatch):
    """Every row finds its successor, whatever the ranges."""
    monkeypatch.setattr(spotsigs, "RANGE", 3)
    rows = [(i * i, f"the text {i} says alpha beta {i}") for i in range(20)]
    got = {r.doc_id: r._next_text for r in spotsigs.with_next(spark.createDataFrame(rows, DOC)).collect()}
    assert got == {rows[i][0]: rows[(i + 1) % 20][1] for i in range(20)}


def test_spotsigs_far_id(spark):
    """One id far from the rest, and ids that are no numbers."""
    rows = [(i, f"the text {i} says alpha beta {i}") for i in [*range(50), 10**15]]
    got = {r.doc_id: r._next_text for r in spotsigs.with_next(spark.createDataFrame(rows, DOC)).collect()}
    assert got == {rows[i][0]: rows[(i + 1) % 51][1] for i in range(51)}
    named = spark.createDataFrame([("b", "the text one"), ("a", "the text two"), (None, "the text none")], "doc_id string, text string")
    assert {r.doc_id: r._next_text for r in spotsigs.with_next(named).collect()} == {None: "the text two", "a": "the text one", "b": "the text none"}


def test_spotsigs_odd_rows(spark):
    made = spotsigs.with_edits(wide(spark, odd_rows())).select("doc_id", "n_chars", spotsigs.fingerprint("_sig").alias("f"), spotsigs.likeness("_sig", "_edited_sig").alias("l")).collect()
    assert len(made) == len(odd_rows()) and {r.f for r in made if r.doc_id in (3, 4)} == {""} and all(0 <= r.l <= 1 for r in made)
    one = spotsigs.with_edits(spark.createDataFrame([(1, "the only document here")], DOC)).select("_edited").first()
    assert one._edited == "the only documenthe o"[:17] + "the o"
    assert spotsigs.with_edits(spark.createDataFrame([], DOC)).count() == 0


def test_similar_pairs(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    sigs = {}
    for r in spotsigs.with_signatures(spark.createDataFrame(docs, DOC), F.col("text"), "s").orderBy("doc_id").collect():
        sigs.setdefault(tuple(r.s), r.doc_id)
    want = {(min(a, b), max(a, b)) for (x, a), (y, b) in itertools.combinations(sigs.items(), 2) if len(set(x) & set(y)) >= 0.6 * len(set(x) | set(y))}
    got = {(r.left, r.right) for r in spotsigs.similar_pairs(spark.createDataFrame(docs, DOC), 0.6).collect()}
    assert got == want


# ---- benchmark items -----------------------------------------------------------------------------

def test_decontamination(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    flat = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))
    want = {(d, i) for d, t in docs for i, b in items if f" {flat(b)} " in f" {flat(t)} "}
    got = {(r.doc_id, r.item_id) for r in decontaminate.op8_decontamination(spark, "/root/testdata/sf0.01").collect()}
    assert want <= got and len(got - want) <= 1


def test_reparameterised_question(spark):
    item = "Alice has 12 apples and gives 5 apples to Bob. How many of the 12 apples that weigh 3 kg does Alice keep for herself?"
    same = "Maria has 40 apples and gives 9 apples to Jorge. How many of the 40 apples that weigh 8 kg does Maria keep for herself?"
    mixed = "Maria has 40 apples and gives 9 apples to Jorge. How many of the 41 apples that weigh 8 kg does Clara keep for herself?"
    other = "Trains leave the station at 9 and arrive at noon while the clock on the tower shows the time of another place."
    docs = spark.createDataFrame([(1, same), (2, mixed), (3, other), (4, None), (5, ""), (6, "short one here")], DOC)
    bench = spark.createDataFrame([(7, item), (8, "short one"), (9, None)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.consistency for r in decontaminate.contaminated(docs, bench).collect()}
    assert (1, 7) in got and got[1, 7] == 1.0 and got.get((2, 7), 0) < 1.0 and (3, 7) not in got and (6, 8) in got
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(wide(spark, odd_rows()), bench).count() == 0


def test_occurrences_are_judged_one_by_one(spark):
    """A copy beside other variants of it, and an item whose own windows repeat."""
    form = "{0} has {1} apples and gives {2} apples to {3}. How many of the {1} apples that weigh {4} kg does {0} keep for herself?"
    item, other, third = form.format("Alice", 12, 5, "Bob", 3), form.format("Maria", 40, 9, "Jorge", 8), form.format("Clara", 77, 2, "Hans", 1)
    numbers = " ".join(str(i * i) for i in range(3, 18))
    rows = [(1, f"{item} {other}"), (2, f"{third} {item} {other}"), (3, f"Sheet: {numbers} end."), (4, f"{other} {third}"), (5, numbers[::-1])]
    bench = spark.createDataFrame([(7, item), (8, numbers)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(rows, DOC), bench).collect()}
    assert {(1, 7), (2, 7), (3, 8), (4, 7)} <= got and (3, 7) not in got and not {(1, 8), (2, 8), (4, 8)} & got


def test_copies_with_other_punctuation_and_case(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [(-1, "Paris is the capital of France"), (-2, "Alice met Bob. Then Carol left. Now Dave sings. Will Eve stay? No.")]
    rows = []
    for i, t in items:
        rows += [(10 * i + 1, re.sub(r"[.!?,\n]+", " ", t)), (10 * i + 2, t.lower()), (10 * i + 3, f'He asked: "{t}"'), (10 * i + 4, t.upper()), (10 * i + 5, t.replace(" ", "\n"))]
    docs = spark.createDataFrame(rows, DOC)
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert {(10 * i + k, i) for i, t in items if re.search(r"\w", t or "") for k in range(1, 6)} <= got


# ---- urls ----------------------------------------------------------------------------------------

def test_cascade_is_exact():
    rng = np.random.default_rng(1)
    keys = rng.integers(-2**62, 2**62, (5000, 2))
    inside, outside = keys[:300], keys[300:]
    levels = [url_filter.Level(inside[:, 0], inside[:, 1], 0.2, 0)]
    yes, no = outside[levels[0].has(outside[:, 0], outside[:, 1])], inside
    while len(yes):
        levels.append(url_filter.Level(yes[:, 0], yes[:, 1], 0.5, len(levels)))
        yes, no = no[levels[-1].has(no[:, 0], no[:, 1])], yes
    assert len(levels) > 2
    assert url_filter.passes(levels, inside[:, 0], inside[:, 1]).all() and not url_filter.passes(levels, outside[:, 0], outside[:, 1]).any()
    assert not url_filter.passes([], inside[:, 0], inside[:, 1]).any()


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://A.NET", "http://A.NET/", "http://x.example.net/en/1", "http://example.com/de/", "http://example.com/de", "ftp://q.org/fr/a?b", "http://notexample.com/de/x", "http://www.spam-farm.example.org/en/1", "http://net/a#b", "http://É.example.net/en/é"]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id int, url string, rule int").drop("rule")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow") and got[3] == ("a.net", "", None, "allow") and got[4][2:] == ("net/", "block")
    assert got[5][2:] == ("example.net/en/", "allow") and got[6][2:] == ("example.com/de/", "block") and got[7][2] is None and got[8][1:] == ("/fr/a", "org/fr/", "allow")
    assert got[9][2] is None and got[10][2:] == (None, "block") and got[11][1:] == ("/a", "net/", "block") and got[12][0] == "É.example.net"
    keys = url_filter.listed_by_join(pages.withColumn("k", F.array("url")), "k", spark.createDataFrame([("http://A.NET",)], "key string"), "f")
    assert {r.page_id for r in keys.collect() if r.f[0]} == {3}
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_listed_domains_as_a_frame(spark):
    """The same verdicts from a frame, of which rows repeat or are null, as from a list."""
    pages = spark.createDataFrame([(1, "http://a.bad.test/x"), (2, "http://good.test/"), (3, "http://notbad.test/"), (4, None)], "page_id int, url string")
    listed = spark.createDataFrame([("bad.test",), ("bad.test",), (None,), ("other.test",)], "key string")
    want = {1: "block", 2: "allow", 3: "allow", 4: "allow"}
    assert {r.page_id: r.verdict for r in url_filter.judge(pages, listed=listed).collect()} == want
    assert {r.page_id: r.verdict for r in url_filter.judge(pages, listed=["bad.test", "other.test"]).collect()} == want


# ---- web archives --------------------------------------------------------------------------------

def test_plain_text():
    page = "<!DOCTYPE html><html><head><title>T</title></head><body><script>var t='</p>';</script><!-- <p>no</p> --><p>One &amp; two<br>three</p><div>a <b>b</b>\n c</div></body></html>"
    assert warc.plain_text(page) == "One & two\nthree\na b c" and warc.plain_text(None) == ""


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(1, "http://a/é\nb", "<p>é</p>"), (2, None, None), (1, "http://a/é\nb", "<p>é</p>")], "page_id bigint, url string, html string")
    source = warc.responses(pages)
    made = warc.derivatives(source)
    both = source.unionByName(made, allowMissingColumns=True)
    data = b"".join(bytes(r.record) for r in warc.records(both).collect())
    parsed = list(warc.parse(data))
    assert len(parsed) == 9
    ids = {f["WARC-Record-ID"] for f, _ in parsed if f["WARC-Type"] == "response"}
    for f, block in parsed:
        assert f["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(block).hexdigest() and (f["WARC-Type"] == "response" or f["WARC-Refers-To"] in ids)
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


def test_plain_text_of_open_heads():
    assert warc.plain_text("<html><head><title>T</title><body><p>text</p></body>") == "text"
    assert warc.plain_text("<head><title>T</title><p>text</p>") == "text" and warc.plain_text("<head><p>" * 3 + "text") == "text"


def test_written_warc_files(spark, tmp_path):
    """Files hold the records one after another and nothing else; derived records name their source's header and digest."""
    import gzip

    pages = spark.createDataFrame([(i, f"http://a/{i}", f"<p>{'wide ' * i}é\r\n\n</p>", "extra") for i in range(40)] + [(41, None, "", None)], "page_id bigint, url string, html string, label string")
    source = warc.responses(pages)
    warc.write_warc(source.unionByName(warc.derivatives(source), allowMissingColumns=True), f"{tmp_path}/w")
    data = b"".join(gzip.open(f).read() for f in sorted(tmp_path.glob("w/*.gz")))
    found = list(warc.parse(data))
    assert len(found) == 3 * 41 and data.endswith(b"\r\n\r\n") and b"\0" not in data and all(f["version"] == "WARC/1.1" for f, _ in found)
    digests = {f["WARC-Record-ID"]: "sha256:" + hashlib.sha256(b.split(b"\r\n\r\n", 1)[1]).hexdigest() for f, b in found if f["WARC-Type"] == "response"}
    assert all(f["X-Source-Payload-Digest"] == digests[f["WARC-Refers-To"]] and f["X-Source-HTTP-Header"].startswith("HTTP/1.1 200 OK") for f, _ in found if f["WARC-Type"] != "response")


# ---- the pipeline --------------------------------------------------------------------------------

def test_pipeline(spark):
    import corpus_pipeline

    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    made = corpus_pipeline.run(spark, SF).collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "substring_dedup", "decontaminate", "sentencepiece"]
    assert 0 < len(made) < len(docs) and len({r.doc_id for r in made}) == len(made)
    assert all(r.doc_id in docs and r.n_chars == len(r.text) <= docs[r.doc_id].n_chars and r.n_ids == len(r.ids) and r.exact for r in made)


def test_quality_stage_computes_features_once(spark):
    """The filter that the optimizer pushes down holds the statistics once."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    count = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(")
    assert 0 < count(corpus_pipeline.quality_stage(spark, docs, SF)) <= count(quality.op4_quality(spark, SF))


def test_pipeline_writes_no_file_for_each_partition(spark, monkeypatch, tmp_path):
    """With 40 partitions that Spark does not join, what a stage writes and returns has as many files as there are cores, and the same rows."""
    import corpus_pipeline

    made, cores = [], spark.sparkContext.defaultParallelism

    def counted(df, tag="stage", *files):
        out = common.cut(df, tag, *files)
        made.append((tag, len(out.inputFiles())))
        return out

    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "20k", "spark.sql.files.openCostInBytes": "1k"}
    old = {k: spark.conf.get(k) for k in conf}
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame([(10**9 + i, f"of their own {i}") for i in range(200)], DOC), allowMissingColumns=True)
    docs.repartition(40).write.parquet(f"{tmp_path}/docs")
    want = {name: sorted(map(str, stage(spark, docs, SF).collect())) for name, stage in corpus_pipeline.STAGES}
    for module in (near_dedup, components, line_dedup, decontaminate):
        monkeypatch.setattr(module, "cut", counted)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        docs = spark.read.parquet(f"{tmp_path}/docs")
        assert docs.rdd.getNumPartitions() > cores
        for name, stage in corpus_pipeline.STAGES:
            result = stage(spark, docs, SF)
            out = common.cut(result, name)
            made.append((name, len(out.inputFiles())))
            assert sorted(map(str, out.collect())) == want[name], name
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert {t for t, _ in made} >= {"signatures", "sets", "digests", "matches"}
    assert {t: n for t, n in made if n > cores} == {}


def test_pipeline_stages_odd_rows(spark):
    """Nulls, empty tables, repeated rows, and columns that have the operators' names."""
    import corpus_pipeline

    names = ("id", "n", "h", "score", "predicted", "n_removed", "removed", "_bad", "class_id", "kept")
    docs = spark.createDataFrame(odd_rows(), DOC).select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF)
        assert made.columns[:len(docs.columns)] == docs.columns and stage(spark, docs.limit(0), SF).count() == 0
        rows = made.collect()
        assert all(r[c] == i for r in rows for i, c in enumerate(names)), name
        kept = [r.doc_id for r in rows]
        if name == "near_dedup":
            assert sorted(x for x in kept if x is not None) == [1, 3, 5, 7, 8] and None in kept
        elif name != "quality":
            assert len(kept) >= len(odd_rows()) - 4
