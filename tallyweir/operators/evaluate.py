"""Evaluation of ranked lists against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def precision_at_k(rows: DataFrame, group: str, rank: str, label: str, ks: list[int], right: str = "right", edge: str = "edge") -> DataFrame:
    """(group, k, shown, labelled, precision, lenient, coverage) in one aggregation; null where nothing is labelled or shown."""
    each = rows.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where(F.col(rank) <= F.col("k"))
    n = lambda cond: F.count_if(cond)
    out = each.groupBy(group, "k").agg(F.count("*").alias("shown"), F.count(label).alias("labelled"), n(F.col(label) == right).alias("r"), n(F.col(label).isin(right, edge)).alias("e"))
    return out.select(
        group, "k", "shown", "labelled",
        F.round(F.try_divide("r", "labelled"), 4).alias("precision"), F.round(F.try_divide("e", "labelled"), 4).alias("lenient"), F.round(F.try_divide("labelled", "shown"), 4).alias("coverage"),
    )


def recall_of(rows: DataFrame, wanted: DataFrame, group: str, key: str) -> DataFrame:
    """(group, wanted, found, recall) of the keys that must be in each group's list."""
    hit = wanted.select(group, key).distinct().join(rows.select(group, key).distinct().withColumn("__hit", F.lit(1)), [group, key], "left")
    return hit.groupBy(group).agg(F.count("*").alias("wanted"), F.count("__hit").alias("found")).withColumn("recall", F.round(F.try_divide("found", "wanted"), 4))


def estimated_precision(rows: DataFrame, group: str, tier: str, label: str, right: str = "right") -> DataFrame:
    """(group, shown, estimate): right rows plus unlabelled ones credited with their tier's precision, over the rows shown.

    A tier without labels is credited with the precision of all tiers together.
    """
    per = rows.groupBy(tier).agg(F.try_divide(F.count_if(F.col(label) == right), F.count(label)).alias("__tier"))
    pooled = rows.agg(F.try_divide(F.count_if(F.col(label) == right), F.count(label)).alias("p")).first()["p"]
    credit = F.when(F.col(label) == right, 1.0).when(F.col(label).isNotNull(), 0.0).otherwise(F.coalesce("__tier", F.lit(pooled).cast("double")))
    same = rows[tier].eqNullSafe(per[tier])
    return rows.join(per, same).groupBy(group).agg(F.count("*").alias("shown"), F.round(F.sum(credit) / F.count("*"), 6).alias("estimate"))
