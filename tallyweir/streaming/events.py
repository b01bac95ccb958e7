"""Event streams and their batch twins: the same expressions serve both."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweir.session import ship_package


def read_events(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_trigger: int = 8) -> DataFrame:
    """A file stream of Parquet events."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def tumbling_counts(events: DataFrame, size: str = "1 hour", late: str | None = None) -> DataFrame:
    """(window_start, event_type, n, total): counts per window and type; with ``late`` as watermark on a stream."""
    if late:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def deduplicated(events: DataFrame, keys: list[str], late: str = "2 hours") -> DataFrame:
    """Events once each, with state dropped behind the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def session_counts(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, session_start, n): sessions of a user parted by gaps."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")


def consecutive_errors(events: DataFrame, key: str = "user_id", error: str = "error") -> DataFrame:
    """(key, run_start, run_length): each run of errors without another event between, as gaps and islands."""
    order = Window.partitionBy(key).orderBy("ts", "event_id")
    island = F.row_number().over(order) - F.row_number().over(Window.partitionBy(key, F.col("event_type") == error).orderBy("ts", "event_id"))
    return events.withColumn("island", island).where(F.col("event_type") == error).groupBy(key, "island").agg(F.min("ts").alias("run_start"), F.count("*").alias("run_length")).drop("island")


def _stop_after(limit: int):
    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        (run,) = state.get if state.exists else (0,)
        fired = []
        for pdf in frames:
            for ts, kind in sorted(zip(pdf["ts"], pdf["event_type"])):
                run = run + 1 if kind == "error" else 0
                if run == limit:
                    fired.append(ts)
        state.update((run,))
        if fired:
            yield pd.DataFrame({"user_id": key[0], "ts": fired, "run_length": limit})

    return step


def error_stops(stream: DataFrame, limit: int = 3) -> DataFrame:
    """(user_id, ts, run_length) whenever a user's errors reach ``limit`` in a row; one counter of state per user."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    ship_package(stream.sparkSession)
    return stream.groupBy("user_id").applyInPandasWithState(_stop_after(limit), "user_id bigint, ts timestamp_ntz, run_length int", "run int", "append", GroupStateTimeout.NoTimeout)


def cooldown(events: DataFrame, key: str = "user_id", trigger: str = "error", hours: int = 24) -> DataFrame:
    """Events with ``blocked``: whether a trigger of the key came within so many hours before."""
    before = Window.partitionBy(key).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("event_type") == trigger, F.col("ts"))).over(before)
    return events.withColumn("blocked", F.coalesce(F.col("ts") < last + F.expr(f"interval {hours} hours"), F.lit(False)))


def rate_excess(events: DataFrame, key: str = "user_id", seconds: int = 3600, most: int = 3) -> DataFrame:
    """Events with ``in_window`` (events of the key in the window that ends here) and whether it exceeds ``most``."""
    window = Window.partitionBy(key).orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("in_window", F.count("*").over(window)).withColumn("excess", F.col("in_window") > most)


def upsert_sink(target: str, keys: list[str], order: str):
    """A ``foreachBatch`` writer: each batch is written under its id, so a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        newest = batch.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in batch.columns if c not in keys]), order).alias("r")).select(*keys, "r.*")
        newest.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return write
