"""Unit changes in series, against planted ones and a brute-force segmentation."""

import datetime as dt
import itertools
import math
import random

import numpy as np
import pytest

from tallyweir.operators.units import follow_scales, market_cap_units, segment

MARKET = "obs_id bigint, security_id string, as_of date, close_price double, price_currency string, market_cap_usd double, market_cap_local double, shares_outstanding double, anchor string"
LINES = "security_id string, price_currency string, fundamental_currency string"


@pytest.mark.parametrize("seed", range(8))
def test_segmentation_is_exact(seed):
    rng = np.random.default_rng(seed)
    values = np.repeat(rng.normal(0, 2, 3), 3) + rng.normal(0, 0.1, 9)
    penalty = 0.3

    def cost(cuts):
        ends = [*cuts[1:], len(values)]
        return sum(((values[a:b] - values[a:b].mean()) ** 2).sum() + penalty for a, b in zip(cuts, ends))

    best = min(cost([0, *c]) for k in range(len(values)) for c in itertools.combinations(range(1, len(values)), k))
    assert cost(list(segment(values, penalty))) == pytest.approx(best)


def test_segment_edges():
    assert list(segment(np.array([]), 1.0)) == [] and list(segment(np.array([5.0]), 1.0)) == [0] and list(segment(np.zeros(50), 0.1)) == [0]
    assert list(follow_scales(np.array([9.0, 9.01, 6.0, 9.02]))) == [0, 0, -3, 0]


def planted(seed=0, lines=30, days=24):
    rng = random.Random(seed)
    market, securities, fx, wrong = [], [], [], set()
    start = dt.date(2026, 1, 2)
    currencies = {"USD": 1.0, "GBP": 1.3, "JPY": 0.0067, "INR": 0.0117}
    for d in range(days):
        fx += [(c, start + dt.timedelta(days=7 * d), r) for c, r in currencies.items()]
    for k in range(lines):
        cur = rng.choice(list(currencies))
        quoted = "GBX" if cur == "GBP" else cur
        securities.append((f"L{k}", quoted, cur if k % 5 else None))
        level, shares = 10 ** rng.uniform(8, 11), 1e8
        for d in range(days):
            level *= math.exp(rng.gauss(0, 0.02))
            obs, local, usd = k * 1000 + d, level * math.exp(rng.gauss(0, 0.002)), level * currencies[cur]
            price = level / shares * (100 if quoted == "GBX" else 1)
            if rng.random() < 0.08:
                local *= 10.0 ** -rng.choice([3, 6, 9])
                wrong.add(obs)
            elif cur == "GBP" and rng.random() < 0.1:
                local *= 100
                wrong.add(obs)
            elif cur in ("JPY", "INR") and rng.random() < 0.05:
                local = usd
                wrong.add(obs)
            elif rng.random() < 0.05:
                usd /= 1000  # a fault elsewhere is no case
            if rng.random() < 0.05:
                usd = None
            market.append((obs, f"L{k}", start + dt.timedelta(days=7 * d), price, quoted, usd, local, shares, "clash"))
    return market, securities, fx, wrong


def run(spark, market, securities, fx):
    found = market_cap_units(spark.createDataFrame(market, MARKET), spark.createDataFrame(securities, LINES), spark.createDataFrame(fx, "currency string, as_of date, usd_per_unit double"))
    return {r["obs_id"]: r for r in found.collect()}


def test_planted_units(spark):
    market, securities, fx, wrong = planted()
    found = run(spark, market, securities, fx)
    assert len(found) == len(market)
    flagged = {o for o, r in found.items() if r["unit_factor"] != 1.0}
    assert len(flagged & wrong) >= 0.98 * len(wrong) and len(flagged - wrong) <= 0.02 * len(flagged)
    true = {m[0]: m[6] for m in market}
    assert all(found[o]["market_cap_main"] == true[o] for o in found.keys() - flagged)


def test_nulls_ties_and_unknown_lines(spark):
    day = dt.date(2026, 1, 2)
    market = [(1, "A", day, None, None, None, None, None, None), (2, "A", day, None, None, None, 0.0, None, None), (3, None, None, None, None, 5.0, float("inf"), None, None), (4, "B", day, 1.0, "XXX", 1e9, 1e9, 1e9, None), (4, "B", day, 1.0, "XXX", 1e9, 1e9, 1e9, None), (None, "B", day, 1.0, "XXX", 1e9, 1e9, 1e9, None)]
    found = market_cap_units(spark.createDataFrame(market, MARKET), spark.createDataFrame([], LINES), spark.createDataFrame([], "currency string, as_of date, usd_per_unit double")).collect()
    assert sorted(r["obs_id"] for r in found) == [1, 2, 3, 4, 4] and all(r["unit_factor"] == 1.0 for r in found)
    assert market_cap_units(spark.createDataFrame([], MARKET), spark.createDataFrame([], LINES), spark.createDataFrame([], "currency string, as_of date, usd_per_unit double")).count() == 0


def test_hot_line_is_split(spark, monkeypatch):
    import tallyweir.operators.units as units

    monkeypatch.setattr(units, "MAX_ROWS", 64)
    day = dt.date(2026, 1, 2)
    market = [(i, "A", day + dt.timedelta(days=i % 300), 10.0, "USD", 1e9, 1e9 if i % 50 else 1e6, 1e8, None) for i in range(600)]
    found = run(spark, market, [("A", "USD", "USD")], [("USD", day + dt.timedelta(days=i), 1.0) for i in range(300)])
    assert {o for o, r in found.items() if r["unit_factor"] != 1.0} == {i for i in range(600) if i % 50 == 0}
