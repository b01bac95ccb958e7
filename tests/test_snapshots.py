"""What changed between full snapshots, against a plain comparison."""

import datetime as dt
import random

import numpy as np
import pytest

from tallyweir.operators.snapshots import Bitmap, CONTAINER, extend_ordinals, snapshot_changes

SNAP = "snapshot_id string, kind string, status string, fetched_at timestamp_ntz, security_id string"
ROWS = "snapshot_id string, row_no bigint, security_id string, name string, seq string"


def day(n):
    return dt.datetime(2026, 1, 1) + dt.timedelta(days=n)


def changes(spark, rows, snaps):
    found = snapshot_changes(spark.createDataFrame(rows, ROWS), spark.createDataFrame(snaps, SNAP))
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("size", [0, 3, 200, 3000])
def test_bitmap_sets(size):
    rng = np.random.default_rng(size)
    a, b = (rng.choice(CONTAINER, size, replace=False) for _ in range(2))
    x, y = Bitmap(a), Bitmap(b)
    assert set(x.and_not(y)) == set(a) - set(b)
    assert set(x.and_(y)) == set(a) & set(b)


def test_rules(spark):
    snaps = [("b", "universe", "ok", day(2), None), ("a", "universe", "ok", day(1), None), ("x", "universe", "partial", day(3), None), ("c", "universe", "ok", day(4), None), ("l", "listing", "ok", day(2), None)]
    rows = [
        ("a", 1, "K1", "Name", None), ("a", 2, "K2", " two  words ", ""), ("a", 3, "K3", "old", "s"), ("a", 4, None, "no key", None), ("a", 5, "K5", "x", None),
        ("b", 1, "K1", "name", None), ("b", 2, "K2", "two words", None), ("b", 3, "K3", "old", "s"), ("b", 9, "K3", "new", "s"), ("b", None, "K3", "null order", "s"), ("b", 4, "K4", "y", None),
        ("x", 1, "K9", "partial pull", None),
    ]
    assert changes(spark, rows, snaps) == sorted([
        ("b", "K1", "changed"), ("b", "K3", "changed"), ("b", "K4", "added"), ("b", "K5", "removed"),
        ("c", "K1", "removed"), ("c", "K2", "removed"), ("c", "K3", "removed"), ("c", "K4", "removed"),
    ])


def test_empty_and_single(spark):
    assert changes(spark, [], []) == []
    assert changes(spark, [("a", 1, "K", "n", None)], [("a", "universe", "ok", day(1), None)]) == []


def test_many_snapshots_match_plain_comparison(spark):
    rng = random.Random(3)
    snaps = [(f"s{i:02d}", "universe", "ok", day(i), None) for i in range(37)]
    rows, before, expected = [], None, []
    for i in range(37):
        now = {f"K{k}": rng.choice("ab") for k in range(40) if rng.random() < 0.8}
        rows += [(f"s{i:02d}", n, k, v, None) for n, (k, v) in enumerate(now.items())]
        if before is not None:
            expected += [(f"s{i:02d}", k, "added") for k in now.keys() - before.keys()] + [(f"s{i:02d}", k, "removed") for k in before.keys() - now.keys()]
            expected += [(f"s{i:02d}", k, "changed") for k in now.keys() & before.keys() if now[k] != before[k]]
        before = now
    assert changes(spark, rows, snaps) == sorted(expected)


def test_ordinals_persist(spark):
    first = extend_ordinals(spark.createDataFrame([("a",), ("b",), (None,)], "k string"), "k")
    more = extend_ordinals(spark.createDataFrame([("b",), ("c",), ("c",)], "k string"), "k", first)
    old, new = dict(first.collect()), dict(more.collect())
    assert old.keys() == {"a", "b"} and new.keys() == {"a", "b", "c"}
    assert all(new[k] == v for k, v in old.items()) and len(set(new.values())) == 3


def test_ordinals_persist(spark, tmp_path):
    from tallyweir.operators.snapshots import stored_ordinals

    folder = str(tmp_path / "ordinals")
    frame = lambda names: spark.createDataFrame([(n,) for n in names], "k string")
    first = {r["k"]: r["ordinal"] for r in stored_ordinals(frame(["a", "b", None, "b"]), "k", folder).collect()}
    again = {r["k"]: r["ordinal"] for r in stored_ordinals(frame(["b"]), "k", folder).collect()}
    assert again == first and [p.name for p in (tmp_path / "ordinals").iterdir()] == ["1"]
    (tmp_path / "ordinals" / "2").mkdir()  # a version that was never finished
    more = {r["k"]: r["ordinal"] for r in stored_ordinals(frame(["c", "a"]), "k", folder).collect()}
    assert set(more) == {"a", "b", "c"} and {k: more[k] for k in first} == first and len(set(more.values())) == 3
