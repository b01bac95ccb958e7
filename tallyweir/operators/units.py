"""Quantities recorded in different units (problem 3).

Each series of a quantity is cut into stretches of one unit by exact penalised changepoint search (optimal partitioning
with pruning) on log values; a level that lies a known factor away from the series' true level is a unit change and
is reversed. The true level comes from a second, independent reading of the same quantity (here a US dollar figure put
into the target currency), itself first freed from scale shifts in the same way: jumps between neighbouring segments that
match a known scale are followed, and the level that most rows hold is taken as right, unless shares times price stand a
known scale above it (figures are stated in too large a unit, never in too small a one).

Distribution: a group is one series times ``BLOCK_DAYS`` days, and a block with over ``MAX_ROWS`` rows is dealt by row hash into
thinner histories of the same period, so that no task holds an unbounded series. Every row is in one group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweir.session import ship_package

BLOCK_DAYS = 728
MAX_ROWS = 4096
NOISE = 0.01  # of log10 values within a unit; sets the penalty of a changepoint
FINE_USD = 10.0  # below it a sum rounded to cents is too coarse to tell small factors
TIGHT, LOOSE, PARITY = 0.006, 0.2, 0.3  # distance to a known factor with and without a fine second reading of the day; factors below the last need one

# Minor units (main unit, minor units in it) and the scales in which sums are stated, as powers of ten.
MINOR_UNITS = {"GBX": ("GBP", 100), "GBp": ("GBP", 100), "ZAC": ("ZAR", 100), "ILA": ("ILS", 100), "USX": ("USD", 100), "EUX": ("EUR", 100)}
SCALES = (3, 4, 5, 6, 7, 8, 9, 12)


def segment(values: np.ndarray, penalty: float) -> np.ndarray:
    """Starts of the segments that minimise squared error around segment means plus ``penalty`` per segment.

    The minimum is exact: dynamic programming over all last changepoints, without those that pruning proves useless.
    """
    n = len(values)
    centred = values - values.mean() if n else values
    if n < 2 or float(centred @ centred) <= penalty:  # no split can save more than the whole error
        return np.zeros(min(n, 1), dtype=np.int64)
    s1 = np.concatenate(([0.0], np.cumsum(centred)))
    s2 = np.concatenate(([0.0], np.cumsum(centred * centred)))
    best = np.empty(n + 1)
    best[0] = -penalty
    back = np.zeros(n + 1, dtype=np.int64)
    open_starts = np.zeros(1, dtype=np.int64)
    for end in range(1, n + 1):
        length = end - open_starts
        total = s1[end] - s1[open_starts]
        cost = best[open_starts] + (s2[end] - s2[open_starts]) - total * total / length
        k = int(np.argmin(cost))
        best[end] = cost[k] + penalty
        back[end] = open_starts[k]
        open_starts = np.append(open_starts[cost <= best[end]], end)
    starts = []
    end = n
    while end > 0:
        end = int(back[end])
        starts.append(end)
    return np.array(starts[::-1], dtype=np.int64)


def follow_scales(values: np.ndarray, scales: tuple[int, ...] = SCALES, tolerance: float = 0.1) -> np.ndarray:
    """For each value the power of ten by which it lies off the level that most values hold.

    Jumps between segments that match no scale are real moves and change no unit. Ties go to the higher level.
    """
    starts = segment(values, penalty(len(values)))
    ends = np.append(starts[1:], len(values))
    shift, at = np.zeros(len(values), dtype=np.int64), 0
    for k, (a, b) in enumerate(zip(starts, ends)):
        if k:
            # the difference between neighbours across all former levels: the nearest segment that explains the jump
            jump = values[a] - values[a - 1]
            size = int(round(abs(jump)))
            if size in scales and abs(abs(jump) - size) <= tolerance:
                at += size if jump > 0 else -size
        shift[a:b] = at
    levels, counts = np.unique(shift, return_counts=True)
    base = levels[len(levels) - 1 - int(np.argmax(counts[::-1]))] if len(levels) else 0
    return shift - base


def penalty(n: int) -> float:
    return 6 * NOISE**2 * np.log(max(n, 2) + 8)


def _reference(second: np.ndarray, anchor: float) -> tuple[np.ndarray, np.ndarray]:
    """The second reading without scale shifts, gaps filled from its neighbours; and where it was read on the day itself.

    ``anchor`` is the usual level of a third reading, which may itself be too low but is not too high.
    """
    has = np.isfinite(second)
    if not has.any():
        return np.full(len(second), np.nan), has
    read = second[has]
    shift = follow_scales(read)
    corrected = read - shift
    off = anchor - np.median(corrected)  # most of the second reading may itself be in too large a unit
    if np.isfinite(off) and int(round(off)) in SCALES and abs(off - round(off)) < 0.35:
        corrected = corrected + round(off)
    return np.interp(np.arange(len(second)), np.flatnonzero(has), corrected), has


def unit_levels(value: np.ndarray, second: np.ndarray, fine: np.ndarray, anchor: float, factors: np.ndarray) -> np.ndarray:
    """For each log10 value the log10 factor (stated over true) of its unit, 0 where it is in whole main units.

    ``second`` is the second reading (NaN where there is none), ``fine`` tells where it is precise, ``anchor`` is the usual
    level of a third reading, ``factors`` the known factors of each row (row by factor). Values that match no factor are held to be right but inexact.
    """
    out = np.zeros(len(value))
    known = np.isfinite(value)
    if not known.any():
        return out
    reference, same_day = _reference(second, anchor)
    v = value[known]
    if not np.isfinite(reference).any():
        out[known] = follow_scales(v)
        out[out > 0] = 0
        return out
    rest = v - reference[known]
    tight = (same_day & fine)[known]
    rows = factors[known]
    starts = segment(rest, penalty(len(rest)))
    for a, b in zip(starts, np.append(starts[1:], len(rest))):
        exact = tight[a:b]
        level = np.median(rest[a:b][exact]) if exact.any() else np.median(rest[a:b])
        tolerance = TIGHT if exact.any() else LOOSE
        f = np.median(rows[a:b], axis=0)
        if abs(level) <= tolerance:
            continue
        distance = np.abs(f - level)
        distance[~np.isfinite(distance)] = np.inf
        if not exact.any():
            distance[np.abs(f) < PARITY] = np.inf  # near parity can't be told from a real move
        k = int(np.argmin(distance))
        # currency factors move with the day, so within a stretch they hold row by row
        if distance[k] <= (tolerance if k < len(SCALES) + 1 else 2 * tolerance):
            index = np.flatnonzero(known)[a:b]
            out[index] = factors[index, k]
    return out


def _levels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = []
        for value, second, fine, anchor, usd, price in zip(pdf["value"], pdf["second"], pdf["fine"], pdf["anchor"], pdf["to_usd"], pdf["to_price"]):
            value, second, usd, price = (np.asarray(x, dtype=float) for x in (value, second, usd, price))
            n = len(value)
            own = np.tile([-float(s) for s in SCALES] + [2.0], (n, 1))
            # in US dollars or the price currency, whole or in minor units, and these in the scales
            other = [x[:, None] + np.array([0.0, 2.0, -3.0, -6.0, -9.0]) for x in (usd, price)]
            other = [np.where(np.abs(o[:, :1]) < 1e-9, np.nan, o) for o in other]
            with np.errstate(invalid="ignore"):
                found.append(unit_levels(value, second, np.asarray(fine, dtype=bool), anchor if anchor is not None else np.nan, np.hstack([own, *other])))
        yield pd.DataFrame({"ids": pdf["ids"], "local": pdf["local"], "factor": found})


def main_unit(currency: Column) -> Column:
    """The currency whose minor unit a code names, else the code itself."""
    table = F.create_map(*[F.lit(x) for k, (main, _) in MINOR_UNITS.items() for x in (k, main)])
    return F.coalesce(table[currency], currency)


def _log10(col: Column) -> Column:
    """log10 of a positive finite number, else null."""
    return F.when((col > 0) & (col < float("inf")), F.log10(col))


def market_cap_units(market: DataFrame, securities: DataFrame, fx: DataFrame) -> DataFrame:
    """(obs_id, unit_factor, market_cap_main) for every row of ``market`` with an id.

    ``unit_factor`` is stated over true (1.0 where the figure is in whole main units of the line's fundamental currency, or of the
    main unit of its price currency where that is null); ``market_cap_main`` is the figure put right. Null, zero, negative
    and infinite figures keep factor 1.0 and their value. Lines that ``securities`` lacks go by the row's own price
    currency; lines without any known currency or rate are judged by their own history alone. A line listed twice in ``securities``
    counts once (smallest codes), a rate given twice as its mean. Repeated rows are judged each for itself.
    """
    ship_package(market.sparkSession)
    lines = securities.where(F.col("security_id").isNotNull()).groupBy("security_id").agg(
        F.min("fundamental_currency").alias("fundamental"), F.min("price_currency").alias("quoted")
    )
    rates = fx.groupBy("currency", "as_of").agg(F.avg("usd_per_unit").alias("rate"))
    rows = market.where(F.col("obs_id").isNotNull()).select(
        "obs_id", "security_id", "as_of", F.col("market_cap_local").alias("local"), F.col("market_cap_usd").alias("usd"), F.col("price_currency").alias("own"),
        (F.col("close_price") * F.col("shares_outstanding")).alias("counted"),
    )
    rows = rows.join(lines, "security_id", "left")
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    quoted = F.coalesce(blank("quoted"), blank("own"))
    rows = rows.withColumn("target", main_unit(F.coalesce(blank("fundamental"), quoted))).withColumn("price", main_unit(quoted)).withColumn("counted", F.col("counted") / F.when(quoted == F.col("price"), 1).otherwise(100)).drop("fundamental", "quoted", "own")
    # one rate table of currencies by days; the optimiser broadcasts it only while its measured size is small
    for name in ("target", "price"):
        rate = rates.select(F.col("currency").alias(name), "as_of", F.col("rate").alias(f"{name}_rate"))
        rows = rows.join(rate, [name, "as_of"], "left")
    rows = rows.select(
        "obs_id",
        "security_id",
        "as_of",
        "local",
        F.floor(F.datediff("as_of", F.lit("2000-01-01")) / BLOCK_DAYS).alias("block"),
        _log10(F.col("local")).alias("value"),
        _log10(F.col("usd") / F.col("target_rate")).alias("second"),
        F.coalesce(F.col("usd") >= FINE_USD, F.lit(False)).alias("fine"),
        _log10(F.col("counted") * F.col("price_rate") / F.col("target_rate")).alias("third"),
        _log10(F.col("target_rate")).alias("to_usd"),
        (_log10(F.col("target_rate")) - _log10(F.col("price_rate"))).alias("to_price"),
    )
    stats = rows.groupBy("security_id", "block").agg(F.count("*").alias("n"), F.percentile_approx("third", 0.5, 1000).alias("anchor"))
    same = (rows["security_id"].eqNullSafe(stats["security_id"])) & (rows["block"].eqNullSafe(stats["block"]))
    dealt = rows.join(stats, same).select(
        rows["*"], stats["anchor"], F.pmod(F.xxhash64("obs_id"), F.ceil(stats["n"] / MAX_ROWS)).alias("part")
    )
    point = F.struct("as_of", "obs_id", "value", "second", "fine", "to_usd", "to_price", "local")
    series = dealt.groupBy("security_id", "block", "part").agg(F.sort_array(F.collect_list(point)).alias("p"), F.first("anchor").alias("anchor"))
    arrays = series.select(
        F.transform("p", lambda x: F.struct(x["obs_id"].alias("obs_id"), x["local"].alias("local"))).alias("ids"), "anchor", *[F.col("p")[c].alias(c) for c in ("value", "second", "fine", "to_usd", "to_price")]
    )
    # only numbers travel to Python and back; ids ride along as an opaque array
    id_type = market.schema["obs_id"].dataType.simpleString()
    arrays = arrays.withColumn("local", F.col("ids")["local"]).withColumn("ids", F.col("ids")["obs_id"])
    judged = arrays.select("ids", "local", "anchor", "value", "second", "fine", "to_usd", "to_price").mapInPandas(_levels, f"ids array<{id_type}>, local array<double>, factor array<double>")
    flat = judged.select(F.explode(F.arrays_zip("ids", "local", "factor")).alias("x"))
    factor = F.pow(F.lit(10.0), F.col("x.factor"))
    return flat.select(
        F.col("x.ids").alias("obs_id"),
        F.when(F.col("x.factor") == 0, F.lit(1.0)).otherwise(factor).alias("unit_factor"),
        F.when(F.col("x.factor") == 0, F.col("x.local")).otherwise(F.col("x.local") / factor).alias("market_cap_main"),
    )
