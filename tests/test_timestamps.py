"""Stamps to instants, against instants written by hand and by Python's own zones."""

import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tallyweir.operators.timestamps import normalise_stamps, parser_table, same_minute_pairs

SOURCES = [("us", "America/New_York"), ("uk", "Europe/London"), ("cn", "Asia/Shanghai"), ("in", "Asia/Kolkata"), ("de", "Europe/Berlin"), ("jp", "Asia/Tokyo"), ("kr", "Asia/Seoul"), ("au", "Australia/Sydney"), ("utc", "UTC"), ("none", None), ("bad", "Mars/Base")]
ROWS = "row_id bigint, source_id string, stamp_raw string, zone_note string, stamp_field string, filing_no string, instant_us string, zone string"

CASES = [
    ("us", "2024-03-10T01:30:00-05:00", None, "2024-03-10 06:30:00"), ("us", "2024-03-11 08:44", None, "2024-03-11 12:44:00"), ("us", "20240311005149", None, "2024-03-11 04:51:49"),
    ("us", "03/04/2024 2:56 PM", None, "2024-03-04 19:56:00"), ("us", "12/31/2024 12:05 AM", None, "2024-12-31 05:05:00"), ("us", "Apr 6, 2025 09:19:54", None, "2025-04-06 13:19:54"),
    ("us", "2024-03-16 15:20 EDT", None, "2024-03-16 19:20:00"), ("us", "2024-03-11 08:44", "UTC-5", "2024-03-11 13:44:00"), ("us", "2024-03-11 08:44", "Asia/Tokyo", "2024-03-10 23:44:00"),
    ("us", "2024-11-03 01:30", None, "2024-11-03 05:30:00"), ("us", "2024-03-10 02:30", None, "2024-03-10 07:30:00"),
    ("uk", "02/04/2024 11:54", None, "2024-04-02 10:54:00"), ("uk", "13/04/2024 11:54", None, "2024-04-13 10:54:00"), ("uk", "04-03-2026 08:22:50", None, "2026-03-04 08:22:50"), ("uk", "2024-03-31 15:08 BST", None, "2024-03-31 14:08:00"),
    ("uk", "01-May-2025 05:42 pm", None, "2025-05-01 16:42:00"), ("uk", "1 Nov 2024, 13:57:33", None, "2024-11-01 13:57:33"), ("uk", "2024-06-01 10:00", "+00:00", "2024-06-01 10:00:00"),
    ("cn", "2025年04月18日10:12:59", None, "2025-04-18 02:12:59"), ("cn", "2024-03-27 08:30 CST", None, "2024-03-27 00:30:00"), ("cn", "1715788812345", None, "2024-05-15 16:00:12"),
    ("in", "2025-09-19 04:26 IST", None, "2025-09-18 22:56:00"), ("in", "2025-09-19 04:26", "UTC+5:30", "2025-09-18 22:56:00"), ("de", "03.11.2024, 11:13:02 Uhr", None, "2024-11-03 10:13:02"), ("de", "01.06.2026 07:28", None, "2026-06-01 05:28:00"),
    ("jp", "２０２５/１０/２７ ０３:０９", None, "2025-10-26 18:09:00"), ("jp", "2024年10月1日 6時05分", None, "2024-09-30 21:05:00"), ("kr", "2024. 3. 16. 오후 3:10", None, "2024-03-16 06:10:00"), ("kr", "2024. 10. 19. 오전 12:49", None, "2024-10-18 15:49:00"),
    ("au", "2024-03-06 14:24 AEDT", None, "2024-03-06 03:24:00"), ("utc", "Sun, 04 Jan 2026 05:38:41 +0000", None, "2026-01-04 05:38:41"), ("utc", "20240309T095357Z", None, "2024-03-09 09:53:57"), ("utc", "2024-03-19 12:45:16.803858+00:00", None, "2024-03-19 12:45:16"),
    ("utc", "1710091648", None, "2024-03-10 17:27:28"), ("utc", " 2024-03-09 16:16 ", None, "2024-03-09 16:16:00"), ("none", "2024-03-09 16:16Z", None, "2024-03-09 16:16:00"),
    ("us", "1950-07-01 12:00", None, "1950-07-01 16:00:00"), ("uk", "1820-01-01 12:00", None, "1820-01-01 12:01:15"), ("us", "2101-07-04 12:00", None, "2101-07-04 16:00:00"), ("us", "2101-03-13 01:59", None, "2101-03-13 06:59:00"), ("us", "2101-03-13 03:00", None, "2101-03-13 07:00:00"),
    ("de", "2399-12-31 23:00", None, "2399-12-31 22:00:00"), ("utc", "20240309T095357+0530", None, "2024-03-09 04:23:57"), ("us", "2024-03-09 14:00 Uhr", None, "2024-03-09 19:00:00"), ("us", "20240311005149", "UTC-05:30", "2024-03-11 06:21:49"),
]


def run(spark, rows):
    made = spark.createDataFrame(rows, ROWS)
    return {r["row_id"]: r for r in normalise_stamps(made, spark.createDataFrame(SOURCES, "source_id string, civil_zone string")).collect()}


def test_instants(spark):
    found = run(spark, [(i, s, raw, note, "published", None, "clash", "clash") for i, (s, raw, note, _) in enumerate(CASES)])
    for i, (source, raw, note, expected) in enumerate(CASES):
        us = found[i]["instant_us"]
        assert us is not None, (source, raw)
        assert str(dt.datetime(1970, 1, 1) + dt.timedelta(seconds=us // 1_000_000)) == expected, (source, raw, note)
        assert found[i]["plain_day"] is None


def test_fractions_and_numbers(spark):
    found = run(spark, [(1, "utc", "2024-03-19 12:45:16.803858+00:00", None, "p", None, None, None), (2, "utc", "2024-03-19T12:45:16.8Z", None, "p", None, None, None), (3, "utc", "1710852316803858123", None, "p", None, None, None), (4, "utc", "1710852316803", None, "p", None, None, None)])
    assert [found[k]["instant_us"] - 1710852316000000 for k in (1, 2, 3, 4)] == [803858, 800000, 803858, 803000]


def test_days_and_nothing(spark):
    day, none = ["20240315", "2024-04-01", "2024.06.27", "2024/06/27", "2024年6月7日"], [None, "", "-", "n/a", "0", "2024-13-40 10:00", "2024-02-30", "99:99", "25:61 tomorrow", "x" * 5000]
    found = run(spark, [(i, "uk", raw, None, "published", None, None, None) for i, raw in enumerate(day + none)])
    assert all(found[i]["instant_us"] is None and found[i]["plain_day"] is not None for i in range(len(day)))
    assert all(found[len(day) + i]["instant_us"] is None and found[len(day) + i]["plain_day"] is None for i in range(len(none)))


def test_midnight_numbers_and_unknown_zones(spark):
    rows = [(1, "cn", "1715788800000", None, "announcementTime", None, None, None), (2, "cn", "1715788800000", None, "published", None, None, None), (3, "none", "2024-01-01 10:00", None, "p", None, None, None), (4, "bad", "2024-01-01 10:00", None, "p", None, None, None), (5, None, "2024-01-01 10:00+01:00", None, "p", None, None, None)]
    found = run(spark, rows)
    assert found[1]["instant_us"] is None and str(found[1]["plain_day"]) == "2024-05-16"
    assert found[2]["instant_us"] == 1715788800000000
    assert found[3]["instant_us"] is None and found[4]["instant_us"] is None and found[5]["instant_us"] == 1704099600000000
    # the offset must hold then: midnight by the winter's offset is no midnight in summer; the new year begins in the old one's UTC
    found = run(spark, [(1, "us", "1720155600000", None, "announcementTime", None, None, None), (2, "us", "1720152000000", None, "announcementTime", None, None, None), (3, "cn", "1735660800000", None, "announcementTime", None, None, None)])
    assert found[1]["plain_day"] is None and str(found[2]["plain_day"]) == "2024-07-05" and str(found[3]["plain_day"]) == "2025-01-01"


@pytest.mark.parametrize("zone,source", [("America/New_York", "us"), ("Europe/Berlin", "de"), ("Australia/Sydney", "au")])
def test_zone_table_matches_python(spark, zone, source):
    local = [dt.datetime(2025, 1, 1) + dt.timedelta(hours=7 * k) for k in range(1250)]
    found = run(spark, [(i, source, t.strftime("%Y-%m-%d %H:%M"), None, "p", None, None, None) for i, t in enumerate(local)])
    for i, t in enumerate(local):
        there = t.replace(tzinfo=ZoneInfo(zone))
        if there.astimezone(dt.timezone.utc).astimezone(ZoneInfo(zone)).replace(tzinfo=None) == t:  # not in a gap
            assert found[i]["instant_us"] == int(there.timestamp()) * 1_000_000, (zone, t)


def test_pairs_match_brute_force(spark):
    rows = [(i, "uk", f"2024-06-01 10:0{i % 3}", None, "p", f"F{i % 4}" if i % 7 else None, None, None) for i in range(40)] + [(1, "uk", "2024-06-01 10:01", None, "p", "F1", None, None)]
    made = normalise_stamps(spark.createDataFrame(rows, ROWS), spark.createDataFrame(SOURCES, "source_id string, civil_zone string"))
    found = sorted(tuple(r) for r in same_minute_pairs(made).collect())
    expected = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[5] and a[5] == b[5] and a[2] == b[2]}
    assert found == sorted(expected)
    empty = made.where(F.lit(False))
    assert same_minute_pairs(empty).count() == 0


def test_each_mask_has_one_parser():
    masks = [r[0] for r in parser_table()]
    assert len(masks) == len(set(masks)) and len(masks) < 20_000
