import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textsieve.functions import normalize as N
from textsieve.operators import filters, inverse, reduce, rules, scan, slicing, templates
from textsieve.sources import ingest, sinks
from textsieve.streaming import stream


def lines(spark, *texts):
    return spark.createDataFrame([(i, n + 1, x) for i, t in enumerate(texts) for n, x in enumerate(t.split("\n"))], "source_id bigint, line_no bigint, line string")


def test_line_ends(spark):
    df = ingest.lines(ingest.strings(spark, {"a": "x\r\ny\n", "b": "", "c": "\n\n", "d": "z"}), "source_id")
    assert sorted(map(tuple, df.collect())) == [("a", 1, "x"), ("a", 2, "y"), ("c", 1, ""), ("c", 2, ""), ("d", 1, "z")]


def test_blocks_reject_zero(spark):
    with pytest.raises(ValueError):
        ingest.blocks(ingest.strings(spark, {"a": "x"}), "source_id", 0)


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_scans_cross_chunks(spark, size):
    rng = random.Random(size)
    rows = [(s, n, rng.choice([None, 1, 2, 3])) for s in range(3) for n in range(rng.randint(0, 30))]
    df = spark.createDataFrame(rows, "source_id int, line_no int, v int")
    last, total, before, want = {}, {}, {}, {}
    for s, n, v in rows:
        last[s] = v if v is not None else last.get(s)
        total[s] = total.get(s, 0) + (v or 0)
        want[s, n] = (last[s], total[s], before.get(s))
        before[s] = v
    out = scan.forward_fill(df, F.col("v"), "f", ["source_id"], size=size)
    out = scan.running_sum(out, F.coalesce("v", F.lit(0)), "t", ["source_id"], size=size)
    out = scan.previous(out, F.col("v"), "p", ["source_id"], size=size)
    assert {(r.source_id, r.line_no): (r.f, r.t, r.p) for r in out.collect()} == want


def test_decoding():
    text = "Größe 12, naïve café"
    for name in ("utf-8", "utf-16-le", "utf-16-be", "cp1252"):
        assert ingest.decode_bytes(text.encode(name))[0] == text, name
    assert ingest.decode_bytes("中文日志，错误信息".encode("gbk"))[0] == "中文日志，错误信息"
    assert ingest.decode_bytes(b"\xff\xfe" + "ab".encode("utf-16-le")) == ("ab", "utf-16-le")
    assert ingest.decode_bytes(None) == ("", "utf-8")
    assert ingest.binary_ratios(b"\0" * 10 + b"abc") and not ingest.binary_ratios("text\n".encode())
    assert not ingest.binary_ratios("plain".encode("utf-16-le"))


def test_repair():
    assert ingest.repair_text("GrÃ¶ÃŸe") == "Größe"
    assert ingest.repair_text("fine") == "fine"
    assert ingest.repair_text(None) == ""


def test_sessions():
    assert [c["command"] for c in ingest.session_commands_of('[{"role": "x", "tool": {"command": "git status", "output_bytes": 5}}, {"cmd": "ls"}]')] == ["git status", "ls"]
    assert ingest.session_commands_of("plain") == [] and ingest.session_commands_of('{"command": "a"}\n{"command": "b"}')[1]["command"] == "b"


def test_balanced_json():
    assert N.all_json('x {"a": "}"} y {"b": {"c": 1}} {') == ['{"a": "}"}', '{"b": {"c": 1}}']
    assert N.balanced_json("none") is None and N.balanced_json('{"a": "\\"}"}') == (0, 12)


def test_dedup_round_trip(spark):
    df = lines(spark, "the same long line\nshort\n$M1 looks like a token\nthe same long line", "the same long line\n$PK1\nérror é é é é\nérror é é é é", "")
    tokens, dictionary = reduce.dedup_lines(df)
    back = inverse.assemble(inverse.resolve(tokens, dictionary))
    assert {r.source_id: r.text for r in back.collect()} == {0: "the same long line\nshort\n$M1 looks like a token\nthe same long line", 1: "the same long line\n$PK1\nérror é é é é\nérror é é é é", 2: ""}
    assert [r.token for r in dictionary.orderBy("first").collect()] == ["$M0", "$M1"]


@pytest.mark.parametrize("n,expected", [(10, False), (11, True), (12, True)])
def test_dedup_minimum(spark, n, expected):
    tokens, _ = reduce.dedup_lines(lines(spark, "x" * n + "\n" + "x" * n))
    assert (tokens.where("kind = 'ref'").count() == 1) == expected


def test_ai_windows(spark):
    kept = filters.ai_lines(lines(spark, "error first\na\nb\nc\nfail\nexception\nd\ne\nfatal last")).orderBy("line_no")
    assert [r.line for r in kept.collect()] == ["error first", "a", "... Skipped 1 normal build lines ...", "c", "fail", "exception", "d", "e", "fatal last"]


def test_no_growth_and_signal(spark):
    df = spark.createDataFrame([("a error b\nc", "short"), ("ab", "abcdef"), ("", "")], "raw string, out string")
    got = [tuple(r) for r in df.select(filters.keep_error_signal(F.col("raw"), F.col("out")), filters.prefer_smaller(F.col("raw"), F.col("out"))).collect()]
    assert got == [("short\na error b", "short"), ("abcdef", "ab"), ("", "")]


def test_drain():
    grown = templates.grow([(["a", "b", "1"], 1, 0), (["a", "b", "2"], 1, 1), (["x", "y", "z"], 1, 2)])
    assert [(t, s) for t, s, *_ in grown] == [(["a", "b", "<*>"], 2), (["x", "y", "z"], 1)]
    assert templates.template_regex(["took", "<*>", "12"]) == r"took\s+(.*?)\s+[0-9]+"


def drain(messages, children=100):
    """Message by message: the tree of nodes, then the nearest template of the leaf."""
    nodes, leaves = {}, {}
    for place, line in messages:
        toks = [t for t in re.split(r"[ =,:;\[\]()]", line) if t]
        if len(toks) < 2:
            continue
        at = (len(toks),)
        for t in toks[1:4]:
            t = "<*>" if re.search("[0-9]", t) else t
            known = nodes.setdefault(at, [])
            if t not in known:
                if len(known) >= children:
                    t = "<*>"
                if t not in known:
                    known.append(t)
            at = (*at, t)
        near = [(sum(a == b for a, b in zip(c["toks"], toks, strict=True)) / len(toks), -i) for i, c in enumerate(leaves.setdefault(at, []))]
        best = max(near, default=(0, 0))
        if best[0] >= 0.5:
            c = leaves[at][-best[1]]
            c["toks"], c["n"] = [a if a == b else "<*>" for a, b in zip(c["toks"], toks, strict=True)], c["n"] + 1
        else:
            leaves[at].append({"toks": toks, "n": 1, "first": place})
    return sorted((" ".join(c["toks"]), c["n"], *c["first"]) for x in leaves.values() for c in x)


def test_drain_message_by_message(spark):
    """The sample log, and messages whose templates change while others repeat."""
    from textsieve.plans.views import log_view

    rng = random.Random(5)
    made = [(k, n, " ".join(["start", rng.choice("ab"), "x", "y", *[rng.choice("pqr") for _ in range(4)]])) for k in range(2) for n in range(1, 400)]
    for df in (log_view(spark, "/root/testdata/sf0.001"), spark.createDataFrame(made, "source_id bigint, line_no bigint, line string")):
        rows = sorted((r.source_id, r.line_no, r.line) for r in df.collect())
        got = templates.mine(df).select(F.array_join("template", " "), "size", "first_source", "first_line").collect()
        assert sorted(map(tuple, got)) == drain([((s, n), x) for s, n, x in rows])


def test_drain_in_batches():
    """Whole batches give what single messages give."""
    rng = random.Random(9)
    made = [[rng.choice(["a", "b", "<*>"]), *[rng.choice("pqrs") for _ in range(6)]] for _ in range(3000)]
    want = templates.grow([(toks, 1, i) for i, toks in enumerate(made)])
    leaf, at = templates.Leaf(), 0
    while at < len(made):
        part = made[at:at + rng.choice([1, 7, 1000])]
        coded = pa.array([t for toks in part for t in toks]).dictionary_encode()
        leaf.extend(coded.indices.to_numpy().reshape(len(part), -1).T, coded.dictionary, lambda i, at=at: at + i)
        at += len(part)
    assert [tuple(c) for c in leaf.clusters] == want and len(want) > 3


def test_drain_reads_messages_twice(spark, tmp_path):
    spark.createDataFrame([(1, n, f"user {n % 9} said word{n}") for n in range(50)], "source_id bigint, line_no bigint, line string").write.parquet(str(tmp_path / "t"))
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    df = spark.read.parquet(str(tmp_path / "t")).mapInArrow(seen, "source_id bigint, line_no bigint, line string")
    assert sum(r["size"] for r in templates.mine(df).collect()) == 50
    assert reads.value <= 100


def test_drain_children_limit(spark):
    df = templates.with_leaf(lines(spark, "\n".join(f"m {chr(97 + i // 26)}{chr(97 + i % 26)} end" for i in range(103)) + "\none"))
    leaves = {r.line_no: r.leaf for r in df.collect()}
    assert leaves[104] is None
    assert len({leaves[i] for i in range(1, 101)}) == 100 and leaves[102] == leaves[103]


def test_rules():
    rule = rules.load_rule('[[sections]]\nname="a"\nenter="^x"\nkeep=["k"]\ndrop=["k"]\n[[sections]]\nname="b"\nenter="^x"\nexit="("\nkeep=["k"]')
    assert {d["code"] for d in rules.diagnose(rule)} == {"keep_drop_overlap", "duplicate_enter", "keep_overlap", "invalid_regex"}
    assert rules.render("{{a}}{{#if b}}!{{s.count}}{{/if}}{{#unless b}}?{{/unless}}", {"a": 1, "b": True, "s": [1, 2]}) == "1!2"
    with pytest.raises(ValueError):
        rules.render("{{#if a}}", {})


def test_tree():
    assert reduce.render_tree(["a/b/c.txt", "a/b/d.txt", "e.txt"], True) == "|- a/b/\n|  |- c.txt\n|  `- d.txt\n`- e.txt"


def test_merge_and_payload(spark):
    chunks = spark.createDataFrame([(0, 10, 4, None, 0), (0, 10, 1, "t1", 1), (0, 0, 0, "t2", 2)], "source_id int, original_size int, compressed_size int, base_timestamp string, chunk int")
    assert tuple(sinks.merge_outputs(chunks).first()) == (0, 20, 5, "t1", 0.25)
    tokens, dictionary = reduce.dedup_lines(lines(spark, "the same long line\nthe same long line"))
    assert sinks.llm_payload(tokens, dictionary).first().text == "[DICT]\n$M0=the same long line\n[DATA]\nthe same long line\n$M0"
    assert '"kind":"ref"' in sinks.to_json(tokens, dictionary).first().json


def test_stream_dictionary(spark, tmp_path):
    d = stream.StreamDictionary(spark, str(tmp_path / "dictionary"))
    first = d.add(lines(spark, "value number one\nvalue number two"), 0)
    assert {r.value: r.token for r in first.collect()} == {"value number one": "$M0", "value number two": "$M1"}
    again = d.add(lines(spark, "value number two\nvalue number six"), 1)
    assert {r.value: r.token for r in again.collect()} == {"value number one": "$M0", "value number two": "$M1", "value number six": "$M2"}
    assert d.add(lines(spark, "value number two"), 1).count() == 3


def test_text_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("one\ntwo\n")
    seen = []
    q = stream.run_batches(stream.text_stream(spark, str(tmp_path / "in")), lambda b, n: seen.extend(r.line for r in b.collect()), str(tmp_path / "cp"))
    q.awaitTermination()
    assert sorted(seen) == ["one", "two"]


def test_inline_paths_go_on_while_they_pay(spark):
    text = "\n".join(f"/area{i:03}-component/file{j}.c" for i in range(70) for j in range(6))
    r = spark.createDataFrame([(text,)], "t string").select(reduce.inline_paths("t").alias("r")).first().r
    names = dict(e.split("=") for e in r.footer.removeprefix("paths: ").split("; "))
    assert len(names) == 70 and "component/" not in r.text
    for k in reversed(names):
        r_text = re.sub(re.escape(k) + r"(?=/)", names[k], r.text if k == next(reversed(names)) else r_text)
    assert r_text == text


def test_ranked_is_dense(spark):
    """More rows than a range's sample holds, and a second column; a dictionary and its references, written apart, fit together."""
    from pyspark.sql import functions as F

    from textsieve.operators import reduce

    n = 120_000
    df = spark.range(n).select(F.xxhash64("id").alias("place"), F.concat(F.lit("value "), F.col("id").cast("string")).alias("value"))
    made = reduce.ranked(df, F.col("place"))
    one = made.agg(F.countDistinct("id").alias("d"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("value").alias("n")).first()
    assert tuple(one) == (n, 0, n - 1, n)
    lines = spark.range(2 * n).select(F.lit(1).alias("source_id"), F.col("id").alias("line_no"), F.concat(F.lit("a line that repeats "), (F.col("id") % n).cast("string")).alias("line"))
    tokens, dictionary = reduce.dedup_lines(lines)
    back = tokens.where("kind = 'ref'").join(dictionary.select("token", F.col("value").alias("line")), tokens["value"] == F.col("token"))
    wrong = back.where(F.col("line") != F.concat(F.lit("a line that repeats "), (F.col("seq") % n).cast("string")))
    assert dictionary.select("token").distinct().count() == n == back.count() and wrong.isEmpty()


def test_chain_stops(spark):
    from textsieve.operators import classify

    add = lambda df: df.withColumn("n", F.col("n") + 1)
    twice = lambda df: df.withColumn("n", F.col("n") * 2)
    one = spark.createDataFrame([(1,)], "n int")
    assert classify.chain(one, add, {add: twice}).first().n == 4
    assert classify.chain(one, add, {add: add}).first().n == 6
    assert classify.chain(one, None, {}).first().n == 1


def test_rule_weights():
    from textsieve.operators import classify

    with pytest.raises(ValueError):
        classify.check_rules((("a", "x", "LogBlock", -0.1),))


def test_chunk_target():
    assert [ingest.chunk_target(*a) for a in ((0, 4), (1000, 4), (8 << 20, 4), (1 << 40, 8), (1 << 20, 0))] == [0, 256 << 10, 2 << 20, 5 << 20, 1 << 20]


def test_metrics(spark):
    df, seen = sinks.observed(spark.createDataFrame([("ab",), (None,), ("é",)], "value string"), "passed")
    df.collect()
    assert sinks.metrics_text(seen.get) == "# TYPE textsieve_bytes counter\ntextsieve_bytes 4\n# TYPE textsieve_rows counter\ntextsieve_rows 3\n"


def test_wide_characters_are_not_parted(spark):
    row = spark.createDataFrame([("ab€cd",)], "t string").select(*[N.trim_to(F.col("t"), n).alias(f"n{n}") for n in range(1, 8)]).first()
    assert tuple(row) == ("a...", "ab...", "ab...", "ab...", "ab€...", "ab€c...", "ab€cd")


def test_paragraph_caps_deal_each_run_to_one_task(spark):
    step = scan.SIZE // 10 + 1
    rows = [(s, n * step, "x" * (5 + n % 3)) for s in range(6) for n in range(60)]
    df = spark.createDataFrame(rows, "source_id bigint, line_no bigint, line string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for larger tables; AQE may still broadcast once sizes are known
    try:
        made = slicing.paragraphs(df, max_lines=7, max_bytes=10**6).select("source_id", "line_start", "n_lines")
        plan = made._jdf.queryExecution().executedPlan().toString().split("MapInPandas")[1].splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    below = [next(k for k in ("Exchange", "Join") if k in x) for x in plan[1:] if "Exchange" in x or "Join" in x]
    assert below[0] == "Exchange"  # not the join's own, which a broadcast takes away
    assert sorted(map(tuple, made.collect())) == [(s, n * step, min(7, 60 - n)) for s in range(6) for n in range(0, 60, 7)]
