"""Relational, text, inference, ranking, evaluation, source and stream operators on literal rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweir.functions import text as tx
from tallyweir.operators import corpus, evaluate, inference, ranking
from tallyweir.operators import relational as rel
from tallyweir.sources import files
from tallyweir.streaming import events as ev


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_latest_and_first(spark):
    df = spark.createDataFrame([("a", 1, 5, "x"), ("a", 2, 1, "y"), ("a", 2, 3, "z"), ("b", None, 1, "n"), (None, 1, 1, "k")], "k string, t int, o int, v string")
    assert sorted(map(str, rows(rel.latest_by(df.where("k is not null"), ["k"], ["t", "o"])))) == [str(("a", 2, 3, "z"))]
    assert [r["v"] for r in rel.first_per_key(df.where("k = 'a'"), ["k"], [F.col("t"), F.desc("o")]).collect()] == ["x"]
    assert rel.latest_by(df.limit(0), ["k"], ["t", "o"]).count() == 0


def test_columns_and_unpivot(spark):
    df = spark.createDataFrame([(1, 2.0)], "a int, extra double")
    schema = T.StructType([T.StructField("b", T.StringType()), T.StructField("a", T.LongType())])
    assert rel.with_missing_columns(df, schema).columns == ["b", "a", "extra"]
    assert rows(rel.unpivot_keep_nulls(spark.createDataFrame([(1, None, 2.0)], "k int, x double, y double"), ["k"], ["x", "y"]).withColumn("value", F.coalesce("value", F.lit(-1.0)))) == [(1, "x", -1.0), (1, "y", 2.0)]


def test_or_join_and_upsert(spark):
    left = spark.createDataFrame([(1, "a", "p"), (2, None, "q"), (3, "z", None)], "l int, x string, y string")
    right = spark.createDataFrame([(10, "a", "p"), (20, "b", "q"), (30, None, None)], "r int, u string, v string")
    assert rows(rel.or_equi_join(left, right, [("x", "u"), ("y", "v")], "l", "r")) == [(1, 10), (2, 20)]
    plan = rel.or_equi_join(left, right, [("x", "u"), ("y", "v")], "l", "r")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    old, new = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), spark.createDataFrame([("b", None), ("c", 3)], "k string, v int")
    assert sorted(map(str, rel.soft_upsert(old, new, ["k"]).collect())) == ["Row(k='a', v=1, active=False)", "Row(k='b', v=None, active=True)", "Row(k='c', v=3, active=True)"]


def test_zip_and_cagr(spark):
    df = spark.createDataFrame([([2020, None, 2022, 2023], [1.0, 2.0, None])], "p array<int>, v array<double>")
    assert df.select(rel.zip_history(F.col("p"), F.col("v")).alias("z")).first()["z"] == [(2020, 1.0), (2022, None)]
    df = spark.createDataFrame([("a", 2020, 100.0), ("a", 2023, 133.1), ("b", 2023, 1.0), ("c", 2020, -1.0), ("c", 2023, 2.0), ("d", 2023, None)], "k string, y int, v double")
    found = {r["k"]: r["cagr"] for r in rel.cagr(df, ["k"], "y", "v").collect()}
    assert found["a"] == pytest.approx(0.1) and found["b"] is None and found["c"] is None and "d" not in found


def test_text_functions(spark):
    texts = ["The quick brown fox jumps over the lazy dog again and again", "これは日本語の文章であり、ひらがなと漢字を含みます。もっと長くします。", "这是一个中文句子用来测试语言检测功能是否正常工作今天天气很好", "이것은 한국어 문장이며 언어 감지를 시험하기 위해 쓰였습니다", "short", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    told = [r["l"] for r in df.orderBy("i").select(tx.detect_language(F.col("t")).alias("l")).collect()]
    assert told == ["en", "ja", "zh", "ko", None, None, None]
    cut = [r["c"] for r in df.orderBy("i").select(tx.truncate_words(F.col("t"), 20).alias("c")).collect()]
    assert cut[0] == "The quick brown…" and cut[4:] == ["short", "", None]
    html = "<html><head><title> A  b </title><style>x{}</style></head><body>One<br>two &amp; three<!-- no --><script>1<2</script></body></html>"
    one = spark.createDataFrame([(html,)], "h string").select(tx.html_text(F.col("h")).alias("t"), tx.html_title(F.col("h")).alias("u")).first()
    assert one["t"].endswith("One two & three") and one["u"] == "A b"
    assert spark.createDataFrame([("Ｆｕｌｌ",), (None,)], "t string").select(tx.nfkc_fold("t").alias("t")).collect()[0]["t"] == "full"
    assert spark.range(1).select(tx.jaccard(tx.bigrams(F.lit("night")), tx.bigrams(F.lit("nacht"))).alias("j")).first()["j"] == pytest.approx(1 / 7)


def test_terms(spark):
    docs = spark.createDataFrame([("Two battery cells here",), ("batterycell",), ("A patented thing; PATENT!",), (None,), ("",)], "text string")
    assert dict(rows(corpus.doc_freq(docs, "text", ["battery cell", "patent", "rare"]))) == {"battery cell": 1, "patent": 1, "rare": 0}


def test_inference(spark):
    items = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y"), ("c", None)], "k string, t string")
    asked = inference.classify(items, "k", "t", lambda texts: [{"yes": float(len(t))} for t in texts])
    assert sorted((r["k"], r["probs"]["yes"]) for r in asked.collect()) == [("a", 1.0), ("b", 1.0)]
    probs = spark.createDataFrame([({"a": 0.6, "b": 0.4}, "a"), ({"a": 0.6, "b": 0.4}, "b"), ({"a": 0.6, "b": 0.6}, "a"), ({"a": 1.0, "z": 0.0}, "a"), ({"a": 1.2, "b": -0.2}, "a")], "p map<string,double>, c string")
    assert [r["v"] for r in probs.select(inference.valid_answer(F.col("p"), F.col("c"), ["a", "b"]).alias("v")).collect()] == [True, False, False, False, False]
    reads = spark.createDataFrame([("i", "x", 0.5), ("i", "y", 0.5), ("i", "x", 0.3), ("i", "y", 0.3)], "k string, l string, p double")
    assert inference.mean_reads(reads, "k", "l", "p", {"x": 1, "y": 0}).first()["l"] == "y"


def test_ranking_and_evaluation(spark):
    df = spark.range(500).select("id", (F.col("id") % 7).alias("s"))
    found = {r["id"]: r["rank"] for r in ranking.ranked(df.repartition(9), [F.desc("s"), F.col("id")]).collect()}
    expected = {i: n for n, i in enumerate(sorted(range(500), key=lambda i: (-(i % 7), i)), 1)}
    assert found == expected
    b, a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, rank int"), spark.createDataFrame([("y", 1), ("z", 2)], "k string, rank int")
    assert sorted(map(str, ranking.ranking_diff(b, a, "k").collect())) == ["Row(k='x', change='removed', rank_before=1, rank_after=None)", "Row(k='y', change='moved', rank_before=2, rank_after=1)", "Row(k='z', change='added', rank_before=None, rank_after=2)"]
    lists = spark.createDataFrame([("g", 1, "right"), ("g", 2, None), ("g", 3, "edge"), ("h", 1, None)], "g string, rank int, label string")
    got = {(r["g"], r["k"]): (r["shown"], r["labelled"], r["precision"], r["lenient"]) for r in evaluate.precision_at_k(lists, "g", "rank", "label", [2, 5]).collect()}
    assert got == {("g", 2): (2, 1, 1.0, 1.0), ("g", 5): (3, 2, 0.5, 1.0), ("h", 2): (1, 0, None, None), ("h", 5): (1, 0, None, None)}


def test_sources(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("t", T.StringType())])
    lines = tmp_path / "in.jsonl"
    lines.write_text('{"id": 1, "source": "a", "t": "x"}\nnot json\n{"id": 2, "source": "b"}\n')
    good, bad = files.read_ndjson(spark, str(lines), schema)
    assert good.count() == 2 and [r["line"] for r in bad.collect()] == ["not json"]
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", None), (3, None, "y"), (4, "gone", "z")], schema)
    licences = spark.createDataFrame([("a", "open"), ("b", "closed")], "source_id string, license_tier string")
    files.write_pack(df, licences, "source", ("open",), str(tmp_path / "pack"), files=1)
    kept, tampered = files.read_pack(spark, str(tmp_path / "pack"), schema)
    assert [tuple(r) for r in kept.collect()] == [(1, "a", "x")] and tampered.count() == 0
    sums = {r["source"]: r["content_sum"] for r in files.manifest(df, "source").collect()}
    assert sums == {r["source"]: r["content_sum"] for r in files.manifest(df.repartition(3), "source").collect()}
    table = spark.createDataFrame([(1, "<table><tr><th>A</th><td>1</td></tr></table><table><tr><td>x<br>y</td></tr></table>")], "id int, h string")
    assert [(r["table_no"], r["cells"]) for r in files.read_html_tables(table, "h", "id").orderBy("table_no").collect()] == [(0, ["A", "1"]), (1, ["x y"])]
    assert rows(files.secret_hits(spark.createDataFrame([(1, "api_key = abcdefgh1"), (2, "nothing"), (3, None)], "id int, t string"), "id", "t")) == [(1, "key_assignment")]


def event_rows():
    start = dt.datetime(2024, 1, 1)
    kinds = "error error error view error error click error error error".split()
    return [(i, start + dt.timedelta(minutes=20 * i), 1, k, 1.0) for i, k in enumerate(kinds)]


def test_stream_equals_batch(spark, tmp_path):
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"
    events = spark.createDataFrame(event_rows(), schema)
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stops = ev.error_stops(ev.read_events(spark, str(tmp_path / "in"), events.schema), 3)
    stops.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    fired = sorted(r["ts"] for r in spark.read.schema(stops.schema).parquet(str(tmp_path / "out")).collect())
    assert fired == [event_rows()[2][1], event_rows()[9][1]]
    assert sorted(r["run_length"] for r in ev.consecutive_errors(events).collect()) == [2, 3, 3]
    assert [r["blocked"] for r in ev.cooldown(events, hours=1).orderBy("event_id").collect()][:5] == [False, True, True, True, True]


def test_entry_contract(spark):
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and {"p1_found", "p3_found", "p6_found"} <= set(queries) and len(queries) > 60
    assert entry.entry(spark).count() > 0


def test_ranking_diff_of_all_suppliers(spark, tmp_path):
    import __spark_entry__ as entry

    lines = [(1, 1, 1, 7, 5.0, 1.0), (1, 2, 1, 7, 4.0, 2.0), (2, 1, 1, 8, 5.0, 1.0), (2, 2, 1, 8, 4.0, 2.0), (3, 1, 1, 9, 1.0, 1.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert rows(entry.queries()["ranking_diff"](spark, str(tmp_path))) == [(7, 1, 1, 1, 5.0, 1.0, "moved", 1, 2), (7, 1, 2, 1, 4.0, 2.0, "moved", 2, 1), (8, 2, 1, 1, 5.0, 1.0, "moved", 1, 2), (8, 2, 2, 1, 4.0, 2.0, "moved", 2, 1)]


def test_packets_without_lang(spark, tmp_path):
    import __spark_entry__ as entry

    spark.createDataFrame([(1, None, "a"), (2, "en", "b"), (3, None, None), *[(k, None, "x") for k in range(4, 12)]], "item_id long, lang string, text string").write.parquet(str(tmp_path / "items.parquet"))
    found = {r["item_id"]: r["packet_no"] for r in entry.queries()["packet_assign"](spark, str(tmp_path)).collect()}
    assert found == {1: 1, 2: 1, 3: 1, **{k: 1 for k in range(4, 10)}, 10: 2, 11: 2}


def test_packets_keep_their_capacity(spark):
    import random

    rng = random.Random(5)
    made = [(k, rng.choice(["a", "b", None]), rng.randint(0, 15)) for k in range(400)]
    df = spark.createDataFrame([*made, (900, "c", 8), (901, "c", 8), (902, "c", 8)], "k int, g string, s int").repartition(5)
    for run in (8_192, 50):
        out = inference.packets(df, "g", "k", "s", 5, 12, run).collect()
        sums = {}
        for r in out:
            sums.setdefault((r["g"], r["packet_no"]), []).append(r["s"])
        assert all(len(v) <= 5 and (sum(v) <= 12 or len(v) == 1) for v in sums.values()) and len(out) == 403
        assert [len(v) for (g, _), v in sorted(sums.items(), key=str) if g == "c"] == [1, 1, 1]
        for g in ("a", "b", None):
            assert {n for h, n in sums if h == g} == set(range(1, 1 + len([1 for h, _ in sums if h == g])))
    # greedy in order: nothing that fits is put off
    ours = {r["k"]: r["packet_no"] for r in inference.packets(df, "g", "k", "s", 5, 12).where("g = 'a'").collect()}
    no, held, filled, expected = 1, 0, 0, {}
    for k, g, s in made:
        if g == "a":
            if held and (held == 5 or filled + s > 12):
                no, held, filled = no + 1, 0, 0
            held, filled = held + 1, filled + s
            expected[k] = no
    assert ours == expected


def test_cut_at_sentences(spark):
    rows_ = [("zh", "第一句话在这里。第二句话也在这里。第三句话没有写完还有很多内容", 20), ("ja", "短い。" + "あ" * 40, 20), ("ko", "가나다 라마바 사아자 차카타 파하가 나다라", 16), ("ko", "첫째 문장이다. 1. 둘째 문장은 아주 길다 길다", 14), ("en", "One. Two words follow here", 20), (None, "สวัสดีครับ ทุกคน วันนี้ อากาศดีมาก", 20)]
    df = spark.createDataFrame(rows_, "l string, t string, n int")
    found = [df.where(F.col("t") == t).select(tx.truncate_words(F.col("t"), n, F.col("l"))).first()[0] for _, t, n in rows_]
    assert found[:2] == ["第一句话在这里。第二句话也在这里。…", "短い。" + "あ" * 16 + "…"] and found[4] == "One. Two words…"
    assert found[2] == "가나다 라마바 사아자…" and len(found[5]) <= 20
    assert found[3] == "첫째 문장이다. 1.…"  # the point after a figure ends no sentence, so the blank decides


def test_term_rules(spark):
    cases = [("AI", "an AI tool", True), ("AI", "an ai tool", False), ("AI", "two AIs", True), ("robot", "robotics", True), ("ev", "evs", True), ("ev", "eves", False), ("电池", "电 池", True), ("AI 代理", "用AI代理", True), ("AI 代理", "XAI代理", False), ("battery cell", "Battery\n cells", True), ("c++", "c++ here", True), ("id", "ＩＤ", True)]
    for term, text, expected in cases:
        got = spark.createDataFrame([(text,)], "t string").where(F.col("t").rlike(tx.term_pattern(term))).count() == 1
        assert got == expected, (term, text)


def test_checkpoint_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from tallyweir.session import checkpoint_folder

    far = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None), conf=SimpleNamespace(get=lambda *_: None))
    with pytest.raises(ValueError):
        checkpoint_folder(far)


def test_inclusion_query_has_all_draws(spark, tmp_path):
    import __spark_entry__ as entry

    lines = [(k, 0.01 * ((k + j) % 10)) for k in range(30) for j in range(3)]
    spark.createDataFrame(lines, "l_suppkey long, l_discount double").write.parquet(str(tmp_path / "lineitem.parquet"))
    shares = [r["inclusion"] * 2_000 for r in entry.queries()["inclusion_probability"](spark, str(tmp_path)).collect()]
    assert shares == pytest.approx([round(x) for x in shares]) and any(round(x) % 20 for x in shares)


def test_inclusion_matches_simulation(spark):
    import numpy as np

    p, sd = [0.2, 0.4, 0.5, 0.55, 0.6, 0.9], [0.1, 0.1, 0.1, 0.1, 0.1, 0.0]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(p, sd))], "k int, p double, sd double")
    found = [r["inclusion"] for r in ranking.inclusion_probability(df, "k", "p", "sd", 3, draws=800).orderBy("k").collect()]
    draws = np.clip(np.random.default_rng(0).normal(p, sd, (20_000, 6)), 0, 1)
    expected = (draws.argsort(axis=1)[:, ::-1][:, :3][:, :, None] == np.arange(6)).any(axis=1).mean(axis=0)
    assert found == pytest.approx(list(expected), abs=0.05) and found[5] == 1.0 and sum(found) == pytest.approx(3)
