"""Total orders, precedence of hand-made decisions, and what changed between two rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweir.session import checkpointed


def ranked(df: DataFrame, order: list[Column], partition: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Rows with their rank in a total order, within ``partition`` or over all rows.

    A rank over all rows is made by range-partitioning and counting the partitions before, so no single task sorts everything.
    """
    if partition:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
    sorted_rows = df.orderBy(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    counts = sorted_rows.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a partition
    inner = Window.partitionBy("__part").orderBy("__at")
    return sorted_rows.withColumn("__rn", F.row_number().over(inner)).join(before.select("__part", "__before"), "__part").withColumn(name, F.col("__before") + F.col("__rn")).drop("__part", "__at", "__rn", "__before")


def numbered(df: DataFrame, partition: list[str], order: list[Column], name: str) -> DataFrame:
    """Rows with their place from 1 within their group, by range partitions over (group, order) and the counts of the parts before, so
    that a group of a third of all rows is numbered by many tasks."""
    # the sample of the ranges and the rows must see one table: a stage that is run again could else cut elsewhere
    parts = checkpointed(df.repartitionByRange(*partition, *order).withColumn("__part", F.spark_partition_id()))
    inside = parts.withColumn("__rn", F.row_number().over(Window.partitionBy("__part", *partition).orderBy(*order)))
    counts = parts.groupBy("__part", *partition).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*partition).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("__part").alias("__p"), *[F.col(c).alias(f"__g_{c}") for c in partition], before.alias("__before"))
    same = F.col("__part") == F.col("__p")
    for c in partition:
        same &= F.col(c).eqNullSafe(F.col(f"__g_{c}"))
    return inside.join(counts, same).select(*df.columns, (F.col("__before") + F.col("__rn")).alias(name))


def top_per_group(df: DataFrame, partition: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group with their rank; partitions keep only their own leaders before the exchange."""
    return ranked(df, order, partition).where(F.col("rank") <= k)


def first_verdict(*columns: str) -> Column:
    """The verdict of the highest authority that gave one: later columns yield to earlier ones."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns])


def ranking_diff(before: DataFrame, after: DataFrame, key: str | list[str], rank: str = "rank") -> DataFrame:
    """(key, change, rank_before, rank_after): rows added, removed or moved between two rankings."""
    keys = [key] if isinstance(key, str) else key
    b, a = before.select(*keys, F.col(rank).alias("rank_before")), after.select(*keys, F.col(rank).alias("rank_after"))
    change = F.when(F.col("rank_before").isNull(), "added").when(F.col("rank_after").isNull(), "removed").when(F.col("rank_before") != F.col("rank_after"), "moved")
    return b.join(a, keys, "full").withColumn("change", change).where(F.col("change").isNotNull()).select(*keys, "change", "rank_before", "rank_after")


def backfilled(df: DataFrame, before: list[Column], now: list[Column], k: int, key: str) -> DataFrame:
    """(key, rank_before, rank_now, backfill): whether a row stands in the first ``k`` now and did not before."""
    both = ranked(df, before, name="rank_before").select(key, "rank_before").join(ranked(df, now, name="rank_now").select(key, "rank_now"), key)
    return both.withColumn("backfill", (F.col("rank_now") <= k) & (F.col("rank_before") > k))


def inclusion_probability(df: DataFrame, key: str, p: str, sd: str, k: int, draws: int = 2_000, seed: int = 11) -> DataFrame:
    """(key, inclusion): share of draws in which a row is among the first ``k`` when its value is read with normal noise, cut to [0, 1].

    Noise comes from a counter-based hash of (seed, key, draw), so a repeated task draws the same. Each draw is a group of its own.
    """
    unit = lambda salt: (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col(key), F.col("draw")), F.lit(1 << 52)) + F.lit(0.5)) / float(1 << 52)
    noise = F.sqrt(-2 * F.log(unit(1))) * F.cos(2 * F.pi() * unit(2))
    drawn = df.select(key, p, sd).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("v", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(p) + noise * F.col(sd))))
    top = top_per_group(drawn, ["draw"], [F.desc("v"), F.col(key)], k).groupBy(key).agg((F.count("*") / draws).alias("inclusion"))
    return df.select(key).join(top, key, "left").select(key, F.coalesce("inclusion", F.lit(0.0)).alias("inclusion"))
