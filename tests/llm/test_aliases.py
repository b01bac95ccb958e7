"""Names: parsing, and resolution of planted variants."""

import random

from tallyweir.llm.aliases import deletions, resolve, same_pairs, within_one_edit
from tallyweir.llm.names import Lexicon, _near, abbreviates, plain, romanise, split_scripts, spread, strip_legal

ROWS = "alias_id bigint, text string, market string, cluster string"
FIRST = ["Balo", "Nirato", "Vesti", "Korami", "Dulefa", "Zenobri", "Talimo", "Perudo", "Hasvike", "Gormila"]
TRADE = ["Foods", "Mining", "Marine Engineering", "Software Technologies"]


def test_scripts():
    assert romanise("ヌラケシ") == "nurakeshi" and romanise("카서유남") == "kaseoyunam" and romanise("シャチ") == "shachi"
    assert plain("Ｆátö　ＬＴＤ") == "Fato LTD" and plain("のてほ農機") == "ノテホ農機" and plain("銘電") == "铭电"
    assert split_scripts("Nona Raga / 노나라가") == ["Nona Raga", "노나라가"] and split_scripts("Sales (The)") == ["Sales (The)"]
    assert spread(["tianru", "guangtai"], 4) == ("tian", "ru", "guang", "tai")


def test_words():
    assert abbreviates("pharm", "pharmaceuticals") and abbreviates("mng", "mining") and abbreviates("inds", "industries") and not abbreviates("food", "mining")
    assert strip_legal(["balo", "foods", "co.", "ltd."])[0] == ["balo", "foods"]
    lexicon = Lexicon(["foods", "marine engineering"], {}, {})
    assert lexicon.readings("Balo Mar. Eng. PLC")[0]["business"] == "marine engineering"
    assert lexicon.readings("Foods, Balo")[0]["core"] == "balo"
    assert all(lexicon.readings(x) == [] for x in (None, "", " ", "n/a", "-", "test"))


def planted():
    rng, rows, owner = random.Random(5), [], {}
    for c, name in enumerate(FIRST):
        trade = TRADE[c % len(TRADE)]
        cut = rng.randrange(1, len(name) - 1)
        for text in (f"{name} {trade} Inc.", f"{name} {trade}", f"{name.upper()} {trade.upper()}", f"{name[:cut]}{name[cut + 1:]} {trade}" if len(name) > 5 else f"{name} {trade} Ltd", f"{trade}, {name}", name):
            owner[len(rows)] = c
            rows.append((len(rows), text, "X" if rng.random() < 0.5 else None, "clash"))
    return rows, owner


def test_planted_variants(spark):
    rows, owner = planted()
    rows += [(900, None, None, None), (901, "", None, None), (902, "n/a", None, None), (903, "n/a", None, None), (904, "Unrelated Thing", None, None)]
    found = {tuple(r) for r in same_pairs(resolve(spark.createDataFrame(rows, ROWS))).collect()}
    expected = {(a, b) for a in owner for b in owner if a < b and owner[a] == owner[b]}
    assert len(found & expected) >= 0.95 * len(expected) and found <= expected


def test_one_edit_matches_brute_force(spark):
    words = ["abcde", "abxde", "abde", "abcdef", "bacde", "zzzzz", "abc"]
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(w,) for w in words], "w string")
    x, y = (frame.select(F.col("w").alias(n), F.explode(deletions(F.col("w"))).alias("k")) for n in ("x", "y"))
    met = {tuple(r) for r in x.join(y, "k").where((F.col("x") < F.col("y")) & within_one_edit(F.col("x"), F.col("y"))).select("x", "y").distinct().collect()}
    assert met == {("abcde", "abxde"), ("abcde", "abcdef"), ("abcde", "bacde"), ("abcde", "abde") if "abcde" < "abde" else (), ("abde", "abxde"), ("abc", "abde") if False else ("abcde", "abde")}


def test_empty(spark):
    assert same_pairs(resolve(spark.createDataFrame([], ROWS))).count() == 0


FOODS = Lexicon(["foods"], {"食品": "foods"}, {})


def clusters(spark, texts):
    rows = resolve(spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], ROWS), lexicon=FOODS).collect()
    found = {}
    for r in rows:
        found.setdefault(texts[r["alias_id"]], set()).add(r["cluster"])
    return found


def test_merged_profiles_block_again(spark):
    """Neither spelling alone has the initial and the rest of the last one: only their merged profile has."""
    found = clusters(spark, ["Carl Smith Foods"] * 3 + ["Karl Smyth Foods", "K. Smith Foods", "Berta Long Foods"])
    assert found["Carl Smith Foods"] == found["Karl Smyth Foods"] == found["K. Smith Foods"] != found["Berta Long Foods"]
    alone = clusters(spark, ["Carl Smith Foods"] * 3 + ["K. Smith Foods"])
    assert alone["Carl Smith Foods"] != alone["K. Smith Foods"]


def test_a_hot_company_keeps_its_slips(spark):
    """Over half of all rows name one company; its slips come several times each, another company's name is as frequent as none is."""
    found = clusters(spark, ["Karamito Foods"] * 600 + ["Karmito Foods"] * 5 + ["Karamitto Food"] * 4 + ["Karamitu Foods"] * 40 + ["Other Thing Foods"] * 100)
    assert found["Karamito Foods"] == found["Karmito Foods"] == found["Karamitto Food"]
    assert len(found["Karamito Foods"] | found["Karamitu Foods"] | found["Other Thing Foods"]) == 3


def test_a_text_of_two_names_merges_them(spark):
    found = clusters(spark, ["Balo Foods"] * 3 + ["ケムリ食品"] * 3 + ["Balo Foods / ケムリ食品", "Nerida Foods"])
    assert found["Balo Foods"] == found["ケムリ食品"] == found["Balo Foods / ケムリ食品"] != found["Nerida Foods"]


def test_no_table_that_grows_is_broadcast(spark, monkeypatch):
    """However small its files, a table of names never goes by way of the driver; phrases of business and few counted keys may."""
    import re

    from tallyweir.llm import aliases

    plans, written = [], aliases.checkpointed

    def noted(df):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df)

    monkeypatch.setattr(aliases, "checkpointed", noted)
    monkeypatch.setattr(aliases, "FEW", 0, raising=False)
    rows, owner = planted()
    for n, text in enumerate(["Carl Smith Foods"] * 3 + ["Karl Smyth Foods", "K. Smith Foods", "Balo Kemuri Mining", "Balu Kemuro Foods"]):
        rows.append((500 + n, text, None, None))
    found = noted(same_pairs(resolve(spark.createDataFrame(rows, ROWS), lexicon=Lexicon(["foods", "mining", "marine engineering", "software technologies"], {}, {}))))
    assert found.count() > len(owner)
    final = [re.split(r"== Initial Plan ==", p)[0] for p in plans]
    sent = [line.strip() for p in final for line in p.split("\n") if re.search("Broadcast(HashJoin|NestedLoopJoin)", line)]
    assert any("SortMergeJoin" in p for p in final)
    assert [line for line in sent if not re.search(r"BroadcastHashJoin \[business#\d+\], \[business#\d+\]", line)] == []


def test_few_made_keys_find_the_same_pairs(spark):
    from tallyweir.llm.aliases import _keyed, _pairs

    made = [(w, w, "", "foods", False, w, None) for w in ("kamito", "kamitoo", "kamit", "hasvike", "hasvke", "vesti")]
    keyed = _keyed(spark.createDataFrame(made, "node string, core string, raw string, business string, initial boolean, first string, rest string"))
    some = keyed.where("core IN ('kamito', 'hasvke')")
    for x, y in ((keyed, some), (some, keyed)):
        met = [sorted(map(tuple, _pairs(x, y, few).collect())) for few in ("", "x", "y")]
        assert met[0] == met[1] == met[2] and len(met[0]) == 3


def test_blocking_misses_no_pair_within_one_edit(spark):
    """All spellings against all of the same business: the keys meet every pair one edit apart."""
    import os

    import pytest
    from pyspark.sql import functions as F

    from tallyweir.llm.aliases import _far_pairs, _keyed, _pairs, read_names
    from tallyweir.llm.names import learn_lexicon
    from tallyweir.session import table

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    rows = table(spark, folder, "aliases")
    read = read_names(rows, "alias_id", "text", "market", learn_lexicon(rows.select("text"))).where("business <> '~' AND NOT initial")
    forms = read.groupBy(F.concat_ws("|", "core", "business").alias("node")).agg(*[F.first(c).alias(c) for c in ("core", "business", "initial", "first", "rest")], F.nullif(F.min("raw"), F.lit("")).alias("raw"), F.count("*").alias("n")).cache()
    known = [tuple(r) for r in forms.select("node", "core", "business", "n").collect()]
    every = [(a, b) for a in known for b in known if a[2] == b[2] and a[0] != b[0]]
    one = {(a[0], b[0]) for a, b in every if min(len(a[1]), len(b[1])) >= 5 and _near(a[1], b[1])}
    keyed = _keyed(forms)
    met = {tuple(r) for r in _pairs(keyed, keyed).select("x", "y").collect()}
    assert len(one) > 20 and one <= met
    two = {(a[0], b[0]) for a, b in every if a[3] == 1 and min(len(a[1]), len(b[1])) >= 8 and any(_near(x, y) for x in _left_out(a[1]) for y in _left_out(b[1]) if abs(len(x) - len(y)) <= 1) and edits(a[1], b[1]) <= 2}
    assert two and two <= {tuple(r) for r in _far_pairs(forms).select("x", "y").collect()}


def _left_out(word):
    return [word] + [word[:i] + word[i + 1 :] for i in range(len(word))]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]
