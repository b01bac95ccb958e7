"""Relational building blocks, each with one plan that holds at scale: a single exchange where one suffices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def latest_by(df: DataFrame, keys: list[str], order: list[str], columns: list[str] | None = None) -> DataFrame:
    """The newest row of each key by ``order`` (later columns break ties): one partially aggregated exchange, no window.

    Rows whose first order column is null are never the newest; keys with only such rows are left out.
    """
    rest = [c for c in (columns or df.columns) if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.where(F.col(order[0]).isNotNull()).groupBy(*keys).agg(best).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key in a total order; Spark keeps only each partition's leaders before the exchange (window group limit)."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(window)).where(F.col("__rn") == 1).drop("__rn")


def with_missing_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the columns of ``schema`` in its order; absent ones are typed nulls, extra ones follow."""
    have = set(df.columns)
    wanted = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    return df.select(*wanted, *[c for c in df.columns if c not in schema.names])


def unpivot_keep_nulls(df: DataFrame, keys: list[str], metrics: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    """Entity-attribute-value rows of a wide table, null values kept, in one pass without exchange."""
    pairs = F.array(*[F.struct(F.lit(m).alias(name), F.col(m).cast("double").alias(value)) for m in metrics])
    return df.select(*keys, F.explode(pairs).alias("__p")).select(*keys, f"__p.{name}", f"__p.{value}")


def or_equi_join(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id) wherever any of the column pairs is equal: a union of equi-joins, never a nested loop."""
    parts = [
        left.where(F.col(a).isNotNull()).select(F.col(left_id), F.col(a).alias("__k")).join(right.where(F.col(b).isNotNull()).select(F.col(right_id), F.col(b).alias("__k")), "__k").select(left_id, right_id)
        for a, b in pairs
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def exists_flag(df: DataFrame, other: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` with a boolean column telling whether ``other`` has the row's key (null keys: false)."""
    marks = other.where(F.col(key).isNotNull()).select(key).distinct().withColumn("__has", F.lit(True))
    return df.join(marks, key, "left").withColumn(name, F.coalesce("__has", F.lit(False))).drop("__has")


def soft_upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same key, other old rows stay with ``active`` false: one full outer join."""
    columns = [c for c in new.columns if c not in keys]
    o = old.select(*keys, F.struct(*columns).alias("__old"))
    n = new.select(*keys, F.struct(*columns).alias("__new"))
    both = o.join(n, keys, "full")
    return both.select(*keys, *[F.coalesce(F.col(f"__new.{c}"), F.when(F.col("__new").isNull(), F.col(f"__old.{c}"))).alias(c) for c in columns], F.col("__new").isNotNull().alias("active"))


def running_budget(df: DataFrame, partition: list[str], order: list[Column], cost: str, budget: float) -> DataFrame:
    """Rows with their running cost within the partition and whether they still fit the budget."""
    window = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("running_cost", F.sum(cost).over(window)).withColumn("fits", F.col("running_cost") <= budget)


def zip_history(periods: Column, values: Column) -> Column:
    """Parallel arrays as an array of (period, value): the overlapping prefix, null periods skipped, null values kept."""
    n = F.least(F.size(periods), F.size(values))
    zipped = F.arrays_zip(F.slice(periods, 1, n).alias("period"), F.slice(values, 1, n).alias("value"))
    return F.filter(zipped, lambda x: x["period"].isNotNull())


def cagr(df: DataFrame, keys: list[str], year: str, value: str, span: int = 3) -> DataFrame:
    """(keys, newest_year, cagr): growth from ``span`` years before the newest year with a value; null unless both are positive."""
    known = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.max(year).alias("newest_year"), F.map_from_entries(F.collect_list(F.struct(year, value))).alias("__m"))
    v1, v0 = F.col("__m")[F.col("newest_year")], F.try_element_at(F.col("__m"), F.col("newest_year") - span)
    growth = F.when((v0 > 0) & (v1 > 0), F.pow(v1 / v0, F.lit(1.0 / span)) - 1)
    return known.select(*keys, "newest_year", growth.alias("cagr"))
