"""Excerpts, fields and relations on literal rows."""

import datetime as dt

from pyspark.sql import functions as F

from tallyweir.functions import evidence as ev
from tallyweir.functions import fields as fl
from tallyweir.sources import schemas


def test_excerpts(spark):
    opening = "The company was founded long ago and makes many things for many people in many countries of the world."
    plain = "Nothing of note stands in this paragraph, which only fills the page with words that nobody will look for at all."
    hit = "Our newest plant makes battery cells for buses and a machine tool for every workshop that still wants to have one."
    near = "Hydraulic presses are repaired by technicians who travelled between customers before remote diagnosis was offered."
    text = "\n\n".join([opening, plain, plain + " x", hit, near])
    df = spark.createDataFrame([(1, text, "hydraulic technicians repaired"), (2, "short", None), (3, "", None), (4, None, None)], "i int, t string, d string")
    found = {r["i"]: r["e"] for r in df.select("i", ev.excerpts(F.col("t"), ["battery cell", "machine tool"], [], F.col("d"), 400, 90).alias("e")).collect()}
    assert [(e["kind"], e["text"]) for e in found[1]] == [("overview", opening), ("keywords", hit), ("description", near)]
    assert [(e["kind"], e["text"]) for e in found[2]] == [("overview", "short")] and not found[3] and not found[4]
    told = df.where("i = 1").select(ev.telling_paragraphs(F.col("t"), ["battery cell"], ["nothing"]).alias("p")).first()["p"]
    assert [(p["at"], p["score"]) for p in told] == [(3, 1.0)]
    seen = df.where("i = 1").select(ev.telling_paragraphs(F.col("t"), ["battery cell"], seen=ev.shown_pieces(F.array(F.lit(hit)))).alias("p")).first()["p"]
    assert seen == []
    cut = df.where("i = 1").select(ev.window(F.lit(plain * 5 + " " + hit), ["machine tool"], 120)).first()[0]
    assert cut.startswith("…") and len(cut) <= 120 and "machine tool" in cut


def test_excerpts_divide_a_text_once(spark):
    made = spark.createDataFrame([("a", "b")], "t string, d string").select(ev.excerpts(F.col("t"), ["battery cell", "machine tool"], ["plant"], F.col("d")))
    plan = made._jdf.queryExecution().analyzed().numberedTreeString()
    assert 1 <= plan.count(r"\n[ \t]*\n") <= 4  # a choice of blocks and lines reads the blocks twice


def test_figures_and_anchors(spark):
    df = spark.createDataFrame([("2023年营业收入12亿元，净利润3亿元，同比增长平稳发展良好",), ("1234 5678",), ("plain words",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(ev.figure_heavy(F.col("t"))).collect()] == [True, True, False, False, False]
    one = spark.createDataFrame([("用HBM和SiC, GLP-1 与 OEM, plain Word x",)], "t string")
    assert one.select(ev.latin_anchors(F.col("t"), ("OEM",))).first()[0] == ["HBM", "SiC", "GLP-1"]


def test_fields(spark):
    row = spark.createDataFrame([(1,)], "i int")
    lit = F.lit
    pairs = [
        (fl.risk_mark(lit("*ST Foo")), "star_st"), (fl.risk_mark(lit("ＳＴ某某")), "st"), (fl.risk_mark(lit("Foo ST")), None), (fl.risk_mark(lit(None).cast("string")), None),
        (fl.money_words(lit(1.26e12)), "1.3T"), (fl.money_words(lit(-2.5e6)), "-2.5M"), (fl.money_words(lit(1234.0)), "1,234"), (fl.money_words(lit(None).cast("double")), "-"),
        (fl.lower_floor(lit(123456.0)), 120000), (fl.lower_floor(lit(50.0)), 49), (fl.lower_floor(lit(-1.0)), 0), (fl.han_number(lit("二十三")), 23), (fl.han_number(lit("十")), 10), (fl.han_number(lit("七")), 7), (fl.han_number(lit("百")), None),
        (fl.latest_due_year(lit(dt.date(2024, 4, 30))), 2022), (fl.latest_due_year(lit(dt.date(2024, 5, 1))), 2023), (fl.not_english(lit("Nestlé’s café")), False), (fl.not_english(lit("Привет мир ok")), True), (fl.not_english(lit("abc 中")), True), (fl.not_english(lit("123")), False),
        (fl.slug(lit("Heat pumps, for Homes!")), "heat-pumps-for-homes"), (fl.region_for(lit("X"), lit("NYSE"), {"X": "Seat"}, {"NYSE": "US"}, ("X",)), "US"), (fl.region_for(lit("X"), lit("?"), {"X": "Seat"}, {"NYSE": "US"}, ("X",)), "Seat"), (fl.region_for(lit(None).cast("string"), lit(None).cast("string"), {"X": "Seat"}, {"NYSE": "US"}), "Other"),
    ]
    found = row.select(*[c.alias(str(i)) for i, (c, _) in enumerate(pairs)]).first()
    assert list(found) == [v for _, v in pairs]
    kinds = [("https://www.exchange.example/x", "official"), ("http://sub.mirror.example", "third_party"), ("quote.example.org/a", "gray"), ("https://acme.example/ir?x=1", "company"), ("", "missing"), (None, "missing"), ("notahost", "missing")]
    df = spark.createDataFrame([(u,) for u, _ in kinds], "u string")
    assert [r[0] for r in df.select(fl.host_kind(F.col("u"), ("exchange.example",), ("quote.example.org",), ("mirror.example",))).collect()] == [k for _, k in kinds]


def test_relations(spark):
    df = spark.createDataFrame([("a", 1, "2024-01-01", "x"), ("a", 2, "2024-01-01", "y"), (None, 3, "2024-01-02", "z"), ("b", 4, "bad", "w")], "security_id string, close_price int, as_of string, extra string")
    made = schemas.conform(df, "market_daily")
    assert made.schema == schemas.schema_of("market_daily") and made.where("security_id = 'b'").first()["as_of"] is None
    assert tuple(schemas.key_faults(made, "market_daily").first()) == ("market_daily", 4, 2, 1)
    after = schemas.upsert(df.where("close_price = 1"), df.where("close_price >= 2"), "market_daily", ["close_price"])
    assert [(r["security_id"], r["close_price"]) for r in after.collect()] == [("a", 2.0)]
    for name in schemas.RELATIONS:
        assert set(schemas.RELATIONS[name][1]) <= set(schemas.schema_of(name).names) and schemas.empty(spark, name).count() == 0
        assert schemas.key_faults(schemas.empty(spark, name), name).first()["rows"] == 0
