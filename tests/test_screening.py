"""Screening rules and listings on literal rows."""

import pytest
from pyspark.sql import functions as F

from tallyweir.operators import screening as sc
from tallyweir.sources import listings as ls


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'map<string,double>' if isinstance(v, dict) else 'double' if isinstance(v, float) else 'boolean' if isinstance(v, bool) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("c")).first()["c"]


@pytest.mark.parametrize(
    "status,label,probs,passes",
    [("ok", "core", {"core": 0.2}, True), ("ok", "adjacent", {"core": 0.2, "adjacent": 0.4}, True), ("ok", "adjacent", {"adjacent": 0.59}, False), ("failed", "core", {"core": 0.9}, False), ("ok", "unrelated", {"core": 0.9}, False), ("ok", None, {}, False)],
)
def test_gate(spark, status, label, probs, passes):
    assert one(spark, sc.passes_gate(F.col("s"), F.col("l"), F.col("p")), s=status, l=label, p=probs) == passes


def test_thin_profiles(spark):
    texts = {None: True, "": True, "x" * 450: True, "x" * 450 + ".": False, "字" * 160 + "。": False, "字" * 100 + "。": True, "x" * 450 + "...": True}
    for text, thin in texts.items():
        assert one(spark, sc.is_thin(F.col("t")), t=text) == thin, text


def test_scores(spark):
    df = spark.createDataFrame([("explicit", 0.5, 1e9, "profile"), ("partial", None, 0.0, "annual_report"), ("contradicted", 0.1, None, "profile"), (None, None, None, None)], "l string, p double, cap double, e string")
    found = [r[0] for r in df.select(sc.score_by_label(F.col("l"), F.col("p"), F.col("cap"), F.col("e"))).collect()]
    assert found == pytest.approx([1.5 + 1 + 0.09, 1.5, -2 + 0.2, 0.0])
    ev = df.select(sc.score_by_expectation(F.lit(0.4), F.lit(0.2), F.col("p"), F.col("cap"), F.col("e"))).collect()
    assert [r[0] for r in ev[:2]] == pytest.approx([0.5 * 1.5 * 0.6 + 1 + 0.09, 3 * 0.4 + 1.5 * 0.2])
    explicit, partial = sc.constrained_probabilities(F.lit(0.4), F.lit(0.2), F.lit("missing"))
    assert tuple(df.select(explicit, partial).first()) == pytest.approx((0.0, 0.6))


def test_tiers(spark):
    df = spark.createDataFrame(
        [(1, "explicit", "own", "supplier", "named", 0.9), (2, "explicit", "own", "supplier", "not_stated", 0.9), (3, "explicit", "component", "supplier", "named", 0.6), (4, "explicit", "component", "supplier", "named", 0.59), (5, "partial", "own", "supplier", "named", 0.9), (6, None, None, None, None, None)],
        "i int, l string, product string, role string, target string, p double",
    )
    facts = {f: (F.col(f), F.col("p")) for f in ("product", "role", "target")}
    assert [r[0] for r in df.orderBy("i").select(sc.judged_tier(F.col("l"), facts, F.lit(True))).collect()] == ["A", "B", "C", "B", "B", "B"]
    assert df.where("i = 3").select(sc.counter_evidence(facts, F.lit(True))).first()[0] == ["product:component"]
    tiers = spark.createDataFrame([(["official-open", None, "gray-private"],), ([],), (["odd", "gray-private"],), (None,)], "t array<string>")
    assert [r[0] for r in tiers.select(sc.most_restricted(F.col("t"))).collect()] == ["gray-private", None, "odd", None]


def test_bands(spark):
    probs = {"maker": 0.3, "reseller": 0.5, "unclear": 0.9}
    assert one(spark, sc.top_outside(F.col("p"), ("unclear",)), p=probs) == 0.5 and one(spark, sc.in_band(F.col("p"), ("unclear",)), p=probs)
    assert one(spark, sc.top_outside(F.col("p"), ("unclear",)), p={"unclear": 1.0}) == 0.0
    assert one(spark, sc.known_labels(F.col("p"), ("maker",)), p=probs) == {"maker": 0.3}


def test_scope_and_order(spark):
    rows = spark.createDataFrame([(f"c{i}", f"s{i}", 1, 10.0 - i, 1.0, "sha", None if i != 4 else "explicit") for i in range(6)], "company_key string, security_id string, tier_rank int, score double, market_cap_usd double, evidence_sha string, verdict string")
    labels = spark.createDataFrame([("c0", "role", "reseller", 0.6, "sha"), ("c1", "role", "reseller", 0.9, "old"), ("c2", "scope", "general", 0.9, "sha"), ("c3", "role", "reseller", 0.59, "sha"), ("c4", "role", "reseller", 0.9, "sha")], "company_key string, family string, value string, p double, evidence_sha string")
    rules = spark.createDataFrame([(1, "role", "reseller", "remove"), (2, "scope", "general", "demote")], "rule_no int, family string, value string, effect string")
    marked = sc.apply_scope(rows, labels, rules, spark.createDataFrame([("c5",)], "company_key string"))
    assert {r["company_key"]: r["scope_effect"] for r in marked.collect()} == {"c0": "remove", "c1": None, "c2": "demote", "c3": None, "c4": "remove", "c5": None}
    assert {r["company_key"] for r in marked.where("scope_unchecked").collect()} == {"c0", "c1", "c2", "c3", "c4"}
    out = {r["company_key"]: (r["rank"], r["backfill"], r["below_cut"]) for r in sc.final_order(marked, 2).collect()}
    # before: c0 c1 | c2 ...; c0 is removed and c2 demoted, so c3 moves up; a person's yes keeps c4 below the cut
    assert out == {"c1": (1, False, False), "c3": (2, True, False), "c4": (3, False, True)}


def test_splits(spark):
    rows = spark.createDataFrame([(f"c{i}",) for i in range(20)], "company_key string")
    labels = [(f"c{i}", "role", "reseller" if i < 6 else "maker", 0.8) for i in range(20)] + [(f"c{i}", "scope", "general" if i < 5 else "focused", 0.8) for i in range(20)] + [(f"c{i}", "geo", "outside" if i > 14 else "inside", 0.7) for i in range(20)]
    found = sc.splits(rows, spark.createDataFrame(labels, "company_key string, family string, value string, p double"), {"role": "maker", "scope": "focused", "geo": "inside"}).collect()
    # the second side lies within the first and is left out
    assert [tuple(r) for r in found] == [("role", "reseller", 6, 14), ("geo", "outside", 5, 15)]


TITLES = [
    ("2025年年度报告摘要（更新后）", (2025, "summary", False, False, True)), ("某某公司：2024年年度报告", (2024, "full", False, False, False)), ("二〇二三年年报", (2023, "full", False, False, False)),
    ("2024年度业绩公告（年度报告摘要）", (2024, "summary", False, False, False)), ("2024年年度报告(英文版)", (2024, "full", True, False, False)), ("2024年年度报告（更正前）", (2024, "full", False, True, False)),
    ("2024年年度报告（已取消）", (2024, "full", False, True, False)), ("关于2024年年度报告的更正公告", None), ("2024年半年度报告", None), ("H股公告-2024年年度报告", None), ("甲公司：乙股份有限公司2024年年度报告", None), ("2024年<em>年度报告</em>", (2024, "full", False, False, False)), ("", None), (None, None), ("2024 Annual Report", None),
]


def test_titles(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TITLES)], "i int, t string")
    found = [r["p"] and tuple(r["p"]) for r in df.orderBy("i").select(ls.title_parts(F.col("t")).alias("p")).collect()]
    assert found == [e for _, e in TITLES]


def test_choice_of_reports(spark):
    rows = [("a", "1", 1, "2023年年度报告"), ("a", "2", 2, "2024年年度报告"), ("a", "3", 3, "2024年年度报告（修订版）"), ("a", "4", 4, "2024年年度报告摘要"), ("b", "5", 1, "2023年年度报告"), ("b", "6", 2, "关于2024年年度报告的公告"), ("c", "7", 1, "其他"), (None, "8", 1, "2024年年度报告")]
    df = spark.createDataFrame(rows, "co string, id string, at int, t string")
    found = sorted(tuple(r) for r in ls.newest_reports(df, "co", "t", "at", "id").collect())
    # b's newer title is not understood, so it has no row
    assert found == [("a", 2024, "full", "3", True), ("a", 2024, "summary", "4", False)]
    forms = spark.createDataFrame([("a", "1", "10-K", 1), ("a", "2", "10-K/A", 2), ("b", "3", "20-F/A", 1), ("c", "4", "8-K", 1), ("d", "5", "10-kt", 3), ("d", "6", "10-K", 1)], "co string, id string, f string, at int")
    assert sorted(tuple(r) for r in ls.latest_annual_filing(forms, "co", "f", "at", "id").collect()) == [("a", "1", "10-K", False), ("b", "3", "20-F/A", True), ("d", "5", "10-kt", False)]


def test_stray_formats(spark):
    row = spark.createDataFrame([(" brk/b ", "113/5/2", "1130230", "US0378331005", "72030", "sehk:00700")], "a string, b string, c string, d string, e string, f string")
    found = row.select(ls.plain_ticker(F.col("a")), ls.republic_date(F.col("b")).cast("string"), ls.republic_date(F.col("c")), ls.listing_key(F.col("d"), F.col("e")), ls.short_code(F.col("e")), ls.canonical_id(F.col("f"), {"SEHK": "HKEX"}, ("HKEX",)), ls.finite(F.lit(float("nan"))), ls.finite(F.lit(2.0))).first()
    assert tuple(found) == ("BRK-B", "2024-05-02", None, "isin:US0378331005", "7203", "HKEX:700", None, 2.0)
    payload = spark.createDataFrame([('{"fields":["cik","name"],"data":[["12","A"],["x",null],[3]]}',), ("not json",), (None,)], "p string")
    assert payload.select(ls.parse_columnar(F.col("p"), "name string, cik int, gone string").alias("r")).collect()[0]["r"] == [("A", 12, None), (None, None, None), (None, 3, None)]
    assert payload.select(F.explode(ls.parse_columnar(F.col("p"), "cik int"))).count() == 3
