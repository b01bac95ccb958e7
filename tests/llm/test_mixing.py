"""Mixing: the capped distribution, shares and caps."""

import os

import pytest

from tallyweir.llm.mixing import _mean, capped_poisson, mix_shares, mix_sources, plan_rates, shuffled_copies
from tallyweir.llm.tokens import TOKENIZER

pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer file")
DOCS = "doc_id bigint, text string, source string, repeats string"
TARGETS = "source string, target_share double, max_repeats int"


@pytest.mark.parametrize("mean,cap", [(0.2, 1), (0.9, 1), (1.0, 1), (1.3, 2), (3.5, 6), (0.0, 3), (4.0, 4), (900.0, 1_000), (990.0, 1_000)])
def test_mean_of_capped_poisson(mean, cap):
    steps = capped_poisson(mean, cap)
    assert len(steps) == cap and all(a <= b for a, b in zip(steps, steps[1:]))
    assert sum(1 - s for s in steps) == pytest.approx(mean, abs=1e-6)
    assert _mean(2.0, 50) == pytest.approx(2.0)


def test_rates():
    rates = plan_rates({"a": 1000, "b": 100, "z": 5}, {"a": (0.5, 1), "b": (0.5, 4), "gone": (0.1, 2)})
    assert rates == {"a": pytest.approx(0.4), "b": pytest.approx(4.0)}
    # a source of little weight does not cut down the others, one of more does
    rates = plan_rates({"a": 1000, "b": 900, "c": 1}, {"a": (0.6, 1), "b": (0.36, 2), "c": (0.04, 3)})
    assert rates == {"a": pytest.approx(1.0), "b": pytest.approx(0.36 / 0.6 * 1000 / 900), "c": 3.0}
    assert plan_rates({"a": 1000, "c": 1}, {"a": (0.9, 1), "c": (0.1, 3)})["a"] == pytest.approx(0.027)
    assert plan_rates({"a": 1000}, {"a": (1.0, 1)}, 5000)["a"] == 1.0 and plan_rates({}, {"a": (1.0, 1)}) == {}


def test_shares_and_caps(spark):
    docs = [(i, f"text number {i} of the large source with some words", "large", "clash") for i in range(4000)]
    docs += [(10_000 + i, f"rare note {i} " * 3, "small", None) for i in range(150)]
    docs += [(20_000, None, "large", None), (20_001, "", "small", None), (20_002, "stray", None, None), (20_003, "other", "untargeted", None)]
    docs += [(30_000 + i, "the very same text", "large" if i % 2 else "small", None) for i in range(40)]
    frame = spark.createDataFrame(docs, DOCS)
    targets = spark.createDataFrame([("large", 0.7, 1), ("small", 0.3, 4), ("absent", 0.1, 2)], TARGETS)
    mixed = mix_sources(frame, targets)
    rows = mixed.collect()
    cap = {"large": 1, "small": 4}
    assert all(1 <= r["repeats"] <= cap[r["source"]] for r in rows) and len({r["doc_id"] for r in rows}) == len(rows)
    assert sum(30_000 <= r["doc_id"] < 30_040 for r in rows) <= 1
    shares = {r["source"]: r for r in mix_shares(mixed, targets).collect()}
    assert shares["absent"]["tokens"] == 0 and abs(shares["large"]["actual_share"] - 0.7) < 0.04
    copies = shuffled_copies(mixed).collect()
    assert len(copies) == sum(r["repeats"] for r in rows) and [c["shuffle_key"] for c in copies] == sorted(c["shuffle_key"] for c in copies)
    assert sorted(map(tuple, mix_sources(frame, targets).collect())) == sorted(map(tuple, rows))


def test_repeated_ids_keep_their_own_sizes(spark):
    docs = [(1, "short", "large", None), (1, "a much longer text under the same id " * 20, "large", None), (2, "short", "large", None)]
    found = sorted(r["n_tokens"] for r in mix_sources(spark.createDataFrame(docs, DOCS), spark.createDataFrame([("large", 1.0, 1)], TARGETS)).collect())
    assert len(found) == 2 and found[0] < 5 < 50 < found[1]


def test_empty(spark):
    targets = spark.createDataFrame([("large", 1.0, 1)], TARGETS)
    assert mix_sources(spark.createDataFrame([], DOCS), targets).count() == 0
    assert mix_sources(spark.createDataFrame([(1, "a", "large", None)], DOCS), spark.createDataFrame([], TARGETS)).count() == 0
