"""Prose or not: trees, statistics and planted documents."""

import random

import numpy as np

from tallyweir.llm.boosting import BoostedTrees, platt
from tallyweir.llm.prose import STATISTICS, document_statistics, prose_probability

DOCS = "doc_id bigint, text string, not_prose string"


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    trees = BoostedTrees().fit(x[:2000], y[:2000])
    assert ((trees.predict(x[2000:]) > 0) == (y[2000:] > 0.5)).mean() > 0.95
    slope, offset = platt(np.array([-4.0, -3, 3, 4]), np.array([0.0, 0, 1, 1]))
    assert 0 < slope < 5 and abs(offset) < 1


def test_statistics_of_odd_texts(spark):
    texts = ["a", "…", "\u0001", "x" * 100_000, "。" * 50, "1\n2\n3", "<p>", "a\n" * 3000, "字" * 300, "\u00a0x"]
    rows = document_statistics(spark.createDataFrame([(i, t, None) for i, t in enumerate([*texts, None, "", " \n\t "])], DOCS)).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    assert all(np.isfinite([r[s] for s in STATISTICS]).all() for r in rows)


def test_statistics_by_hand(spark):
    text = "The Pump runs well.\n- 12 bolts"
    r = document_statistics(spark.createDataFrame([(1, text, None), (1, text, None)], DOCS)).collect()
    assert len(r) == 2 and r[0] == r[1]
    r = r[0]
    assert np.isclose([r["n_chars"], r["n_words"], r["n_lines"]], np.log1p([len(text), 5, 2])).all()
    assert np.isclose([r["mean_word_length"], r["digit_ratio"], r["line_end_share"], r["upper_ratio"]], [4, 2 / len(text), 0.5, 2 / 20], atol=0.02).all()
    assert np.isclose(r["bullet_share"], 10 / 29) and r["short_line_share"] == 1.0


def test_a_long_text_is_read_to_its_end(spark):
    lines = "bolts, nuts\n" * 40_000
    tail = "The company sold more of its pumps than in the year before because demand had grown. " * 8
    a, b = document_statistics(spark.createDataFrame([(1, lines, None), (2, lines + tail, None)], DOCS)).orderBy("doc_id").collect()
    assert b["sentence_share"] > a["sentence_share"] == 0 and b["variety"] > a["variety"] and b["n_chars"] > a["n_chars"]


def planted():
    rng = random.Random(4)
    nouns = ["pump", "valve", "engine", "sensor", "gearbox", "pipe", "motor"]
    prose = lambda: f"The company sold more of its {rng.choice(nouns)}s than in the year before because the demand in the region had grown."
    label = lambda: f"{rng.choice(nouns)}s, {rng.choice(nouns)}s"
    docs, junk = [], set()
    for i in range(300):
        kind = i % 5
        text = {0: " ".join(prose() for _ in range(4)), 1: "\n".join(label() for _ in range(15)), 2: "\n".join(f"{rng.choice(nouns)}   {rng.randint(100, 9999)}   {rng.randint(100, 9999)}" for _ in range(9)), 3: " ".join(prose() for _ in range(5)) + "\n" + label(), 4: prose().upper() + " " + prose().upper()}[kind]
        if kind in (1, 2):
            junk.add(i)
        docs.append((i, text, "clash"))
    return docs, junk


def test_planted_documents(spark):
    docs, junk = planted()
    docs += [(900, None, None), (901, "", None), (902, " \n ", None)]
    rows = prose_probability(spark.createDataFrame(docs, DOCS)).collect()
    assert {r["doc_id"] for r in rows} == {d[0] for d in docs if d[0] < 900}
    flagged = {r["doc_id"] for r in rows if r["not_prose"] > 0.5}
    assert len(flagged ^ junk) <= 6


def test_trees_against_pieces(spark):
    """The trees are no copy of the share of junk among the pieces: on texts half of whose pieces are in doubt they may differ, and are no worse."""
    docs, junk = planted()
    rng = random.Random(9)
    nouns = ["pump", "valve", "engine", "sensor", "gearbox", "pipe", "motor"]
    run_on, tables = set(range(1000, 1060)), set(range(2000, 2060))
    docs += [(k, " ".join(", ".join(f"{rng.choice(nouns)}s, {rng.choice(nouns)}s" for _ in range(4)) + "." for _ in range(4)), None) for k in run_on]
    docs += [(k, "The company sold more pumps because demand had grown in the region.\n" * 3 + "\n".join(f"{rng.choice(nouns)} {rng.randint(1, 99)}" for _ in range(6)), None) for k in tables]
    rows = {r["doc_id"]: r for r in prose_probability(spark.createDataFrame(docs, DOCS)).collect()}
    missed = lambda c: sum((r[c] > 0.5) != (k in junk | run_on) for k, r in rows.items())
    assert missed("not_prose") <= max(8, missed("junk_share"))


def test_empty(spark):
    assert prose_probability(spark.createDataFrame([], DOCS)).count() == 0
