"""Queries of the training-data problems that belong to the core: 1, 3 and 6."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweir.operators.snapshots import snapshot_changes
from tallyweir.operators.timestamps import normalise_stamps, same_minute_pairs
from tallyweir.operators.units import market_cap_units
from tallyweir.session import checkpoint_folder, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the dictionary of these tables' keys outlives the run in the shared folder
    folder = f"{checkpoint_folder(spark)}/ordinals/{hashlib.sha1(sf_dir.encode()).hexdigest()[:12]}"
    return snapshot_changes(table(spark, sf_dir, "universe_rows"), table(spark, sf_dir, "snapshots"), ordinal_folder=folder)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = market_cap_units(*(table(spark, sf_dir, t) for t in ("market_daily", "securities", "fx_rates")))
    return units.where(F.col("unit_factor") != 1.0).select("obs_id").distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_minute_pairs(normalise_stamps(table(spark, sf_dir, "filing_rows"), table(spark, sf_dir, "sources")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p3_found": p3_found, "p6_found": p6_found}


# The forms that the tables hold, written out in SQL without masks, parsers or zone rows of our own.
_MONTHS = "list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], lower(substring({}, 1, 3)))"
_OFFSETS = "WHEN 'UTC' THEN 0 WHEN 'GMT' THEN 0 WHEN 'EST' THEN -300 WHEN 'EDT' THEN -240 WHEN 'CET' THEN 60 WHEN 'CEST' THEN 120 WHEN 'JST' THEN 540 WHEN 'KST' THEN 540 WHEN 'AEST' THEN 600 WHEN 'AEDT' THEN 660 WHEN 'BST' THEN 60 WHEN 'IST' THEN 330 WHEN 'CST' THEN CASE WHEN civil LIKE 'Asia/%' THEN 480 ELSE -360 END"
ORACLE = {"p6_found": rf"""
WITH r AS (SELECT f.row_id, f.filing_no, f.stamp_field, trim(regexp_replace(translate(stamp_raw, '０１２３４５６７８９／：', '0123456789/:'), '\s+', ' ', 'g'), ' ') AS s, nullif(trim(zone_note), '') AS note, s.civil_zone AS civil FROM filing_rows f LEFT JOIN sources s USING (source_id)),
a AS (SELECT *, regexp_extract(s, '^([0-9]{{4}})[-/.年] ?([0-9]{{1,2}})[-/.月] ?([0-9]{{1,2}})[日.]?[T ]*(오전|오후)? ?([0-9]{{1,2}})[:時]([0-9]{{2}})', ['y', 'm', 'd', 'p', 'h', 'i']) AS iso,
 regexp_extract(s, '^([0-9]{{4}})([0-9]{{2}})([0-9]{{2}})T?([0-9]{{2}})([0-9]{{2}})(?:[0-9]{{2}})?Z?$', ['y', 'm', 'd', 'h', 'i']) AS run,
 regexp_extract(s, '^([0-9]{{1,2}})[-/.]([0-9]{{1,2}})[-/.]([0-9]{{4}}),? ([0-9]{{1,2}}):([0-9]{{2}})', ['d', 'm', 'y', 'h', 'i']) AS dmy,
 regexp_extract(s, '^(?:[A-Za-z]{{3}}, )?([0-9]{{1,2}})[ -]([A-Za-z]{{3}})[ -]([0-9]{{4}}),? ([0-9]{{1,2}}):([0-9]{{2}})', ['d', 'm', 'y', 'h', 'i']) AS dby,
 regexp_extract(s, '^([A-Za-z]{{3}}) ([0-9]{{1,2}}), ([0-9]{{4}}) ([0-9]{{1,2}}):([0-9]{{2}})', ['m', 'd', 'y', 'h', 'i']) AS bdy,
 regexp_extract(s, '([+-])([0-9]{{2}}):?([0-9]{{2}})$', ['g', 'h', 'i']) AS off, upper(regexp_extract(s, ' ([A-Za-z]{{2,4}})$', 1)) AS word, regexp_matches(s, '^[0-9]{{10}}$|^[0-9]{{13}}$') AS epoch FROM r),
b AS (SELECT *, civil LIKE 'America/%' AS us, CASE WHEN iso.y <> '' THEN [iso.y, iso.m, iso.d, iso.h, iso.i] WHEN run.y <> '' AND length(s) IN (12, 14, 16) THEN [run.y, run.m, run.d, run.h, run.i] WHEN dmy.y <> '' THEN [dmy.y, dmy.m, dmy.d, dmy.h, dmy.i]
 WHEN dby.y <> '' THEN [dby.y, CAST({_MONTHS.format("dby.m")} AS VARCHAR), dby.d, dby.h, dby.i] WHEN bdy.y <> '' THEN [bdy.y, CAST({_MONTHS.format("bdy.m")} AS VARCHAR), bdy.d, bdy.h, bdy.i] END AS v, dmy.y <> '' AND iso.y = '' AS short FROM a),
c AS (SELECT *, list_transform(v, lambda x: TRY_CAST(x AS INTEGER)) AS n FROM b WHERE v IS NOT NULL AND NOT epoch),
e AS (SELECT *, short AND ((us AND n[3] <= 12) OR n[2] > 12) AS swap, CASE WHEN (word = 'PM' OR iso.p = '오후') AND n[4] < 12 THEN n[4] + 12 WHEN (word = 'AM' OR iso.p = '오전') AND n[4] = 12 THEN 0 ELSE n[4] END AS hour FROM c),
l AS (SELECT *, make_timestamp(n[1], CASE WHEN swap THEN n[3] ELSE n[2] END, CASE WHEN swap THEN n[2] ELSE n[3] END, hour, n[5], 0.0) AS local,
 CASE WHEN off.h <> '' THEN (CASE off.g WHEN '-' THEN -1 ELSE 1 END) * (TRY_CAST(off.h AS INTEGER) * 60 + TRY_CAST(off.i AS INTEGER)) WHEN regexp_matches(s, '[0-9]Z$') THEN 0 WHEN word NOT IN ('', 'AM', 'PM', 'UHR') THEN CASE word {_OFFSETS} END
 WHEN regexp_matches(note, '^(?:UTC)?[+-][0-9]') THEN (CASE WHEN note LIKE '%-%' THEN -1 ELSE 1 END) * (CAST(regexp_extract(note, '[+-]([0-9]{{1,2}})', 1) AS INTEGER) * 60 + coalesce(TRY_CAST(nullif(regexp_extract(note, ':([0-9]{{2}})$', 1), '') AS INTEGER), 0)) WHEN note IS NOT NULL AND note NOT LIKE '%/%' THEN CASE note {_OFFSETS} END END AS shift,
 CASE WHEN note LIKE '%/%' THEN note ELSE civil END AS zone FROM e WHERE TRY_CAST(printf('%04d-%02d-%02d', n[1], CASE WHEN swap THEN n[3] ELSE n[2] END, CASE WHEN swap THEN n[2] ELSE n[3] END) AS DATE) IS NOT NULL AND hour < 24 AND n[5] < 60),
z AS (SELECT row_id, filing_no, local, zone, shift, CASE WHEN shift IS NULL AND zone IS NOT NULL THEN local AT TIME ZONE zone END AS t FROM l),
m AS (SELECT row_id, filing_no, CASE WHEN shift IS NOT NULL THEN epoch_us(local) // 60000000 - shift ELSE epoch_us(CASE WHEN timezone(zone, t - INTERVAL 1 HOUR) = local THEN t - INTERVAL 1 HOUR ELSE t END) // 60000000 END AS minute FROM z WHERE shift IS NOT NULL OR t IS NOT NULL
 UNION ALL SELECT row_id, filing_no, us // 60000000 FROM (SELECT *, TRY_CAST(s AS BIGINT) * CASE WHEN length(s) = 10 THEN 1000000 ELSE 1000 END AS us FROM a WHERE epoch) WHERE NOT (stamp_field = 'announcementTime' AND civil IS NOT NULL AND coalesce(epoch_us(timezone(civil, make_timestamp(us) AT TIME ZONE 'UTC')) % 86400000000 = 0, false)))
SELECT DISTINCT least(x.row_id, y.row_id) AS row_id_a, greatest(x.row_id, y.row_id) AS row_id_b FROM m x JOIN m y ON x.filing_no = y.filing_no AND x.minute = y.minute AND x.row_id < y.row_id
"""}
