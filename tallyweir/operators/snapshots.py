"""What changed between full snapshots (problem 1).

Keys get persistent ordinals, kept in a dictionary that later deliveries only extend. The ordinal space is cut into
containers of ``CONTAINER`` ordinals. Within a container every snapshot is a bitmap, kept compressed the roaring way
(sorted 16-bit positions while sparse, packed words once dense), and AND-NOT of consecutive bitmaps yields additions
and removals. Column values become 64-bit hash vectors aligned to the ordinals; where both bitmaps hold a bit, unequal
vectors are changes.

Distribution: a group is one container times a run of ``RUN`` consecutive snapshots, so its size is bounded by
``CONTAINER * (RUN + 1)`` rows whatever the number of keys, rows or snapshots. Rows at a run's end are sent to two groups.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweir.functions.blanks import squeeze
from tallyweir.session import checkpointed, ship_package

CONTAINER_BITS = 12
CONTAINER = 1 << CONTAINER_BITS
SPARSE_LIMIT = CONTAINER // 16  # below this many positions a sorted list is smaller than packed words
RUN = 16


class Bitmap:
    """A compressed set of positions below ``CONTAINER``: sorted uint16 list while sparse, packed bits once dense."""

    __slots__ = ("dense", "data")

    def __init__(self, positions: np.ndarray):
        positions = np.unique(np.asarray(positions, dtype=np.uint16))
        self.dense = len(positions) > SPARSE_LIMIT
        if self.dense:
            bits = np.zeros(CONTAINER, dtype=bool)
            bits[positions] = True
            self.data = np.packbits(bits)
        else:
            self.data = positions

    def positions(self) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(self.data)).astype(np.uint16) if self.dense else self.data

    def _binary(self, other: "Bitmap", dense_op, sparse_op) -> np.ndarray:
        if self.dense and other.dense:
            return np.flatnonzero(np.unpackbits(dense_op(self.data, other.data))).astype(np.uint16)
        return sparse_op(self.positions(), other.positions())

    def and_not(self, other: "Bitmap") -> np.ndarray:
        """Positions of this set that ``other`` lacks."""
        return self._binary(other, lambda a, b: a & ~b, lambda a, b: np.setdiff1d(a, b, assume_unique=True))

    def and_(self, other: "Bitmap") -> np.ndarray:
        """Positions of both sets."""
        return self._binary(other, lambda a, b: a & b, lambda a, b: np.intersect1d(a, b, assume_unique=True))


def extend_ordinals(keys: DataFrame, key: str, known: DataFrame | None = None) -> DataFrame:
    """Dictionary (``key``, ``ordinal``) of all distinct keys: known keys keep theirs, new ones are numbered after them.

    Null keys get no ordinal. Ordinals are written (checkpoint) before use, so a lost executor can't renumber them.
    """
    fresh = keys.select(key).where(F.col(key).isNotNull()).distinct()
    if known is None:
        return checkpointed(fresh.withColumn("ordinal", F.monotonically_increasing_id()))
    # the high 31 bits hold the writer's partition; later writers start above the highest one used
    base = known.agg(F.coalesce(F.max(F.shiftright("ordinal", 33)) + 1, F.lit(0)).alias("base")).first()["base"]
    new = fresh.join(known.select(key), key, "left_anti").withColumn("ordinal", F.monotonically_increasing_id() + F.lit(int(base) << 33))
    return checkpointed(known.select(key, "ordinal").unionByName(new))


def stored_ordinals(keys: DataFrame, key: str, folder: str) -> DataFrame:
    """The dictionary kept under ``folder``, extended by the keys it lacks.

    Each extension is a new version beside the old ones, complete or absent: a run that fails leaves the last version, and one
    that brings no new key writes none. A key keeps its ordinal for as long as the folder is kept. One writer at a time.
    """
    spark = keys.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    base = hadoop.Path(folder)
    files = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    versions = []
    if files.exists(base):
        versions = [int(s.getPath().getName()) for s in files.listStatus(base) if s.getPath().getName().isdigit() and files.exists(hadoop.Path(s.getPath(), "_SUCCESS"))]
    kind = keys.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("ordinal", T.LongType())])
    known = spark.read.schema(schema).parquet(f"{folder}/{max(versions)}") if versions else None
    if known is not None and keys.where(F.col(key).isNotNull()).join(known, key, "left_anti").isEmpty():
        return known
    path = f"{folder}/{max(versions, default=0) + 1}"
    extend_ordinals(keys, key, known).select(key, "ordinal").write.mode("overwrite").parquet(path)
    return spark.read.schema(schema).parquet(path)


def complete_snapshots(snapshots: DataFrame, kind: str = "universe") -> DataFrame:
    """Complete snapshots of a kind with their place in time (``seq`` from 0) and their number (``total``).

    Ties in ``fetched_at`` go by snapshot_id. One row per delivery, so the single window partition holds
    a list of deliveries, never their rows.
    """
    full = snapshots.where((F.col("kind") == kind) & (F.col("status") == "ok") & F.col("fetched_at").isNotNull())
    full = full.groupBy("snapshot_id").agg(F.min("fetched_at").alias("fetched_at"))
    order = Window.orderBy("fetched_at", "snapshot_id")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return full.select("snapshot_id", (F.row_number().over(order) - 1).alias("seq"), F.count("*").over(every).cast("int").alias("total"))


def snapshot_changes(
    rows: DataFrame,
    snapshots: DataFrame,
    key: str = "security_id",
    order: str = "row_no",
    kind: str = "universe",
    known: DataFrame | None = None,
    ordinal_folder: str | None = None,
) -> DataFrame:
    """(snapshot_id, key, change) for every record added, removed or changed against the complete snapshot before.

    Result rules: rows with a null key are ignored. Of a key delivered twice the row with the higher ``order``
    holds; a null ``order`` is lowest, equal orders are settled by the row's contents. Blanks at the ends, runs of
    blanks and empty against null are no change; letter case is. Snapshots that delivered no rows remove every line.
    Fewer than two complete snapshots give an empty result. All columns but snapshot_id, ``order`` and ``key`` are
    compared, whatever they are called. With ``ordinal_folder`` the keys' ordinals persist there from run to run (see
    ``stored_ordinals``); else they are numbered for this run, after those of ``known`` if that is given.
    """
    ship_package(rows.sparkSession)
    values = [c for c in rows.columns if c not in ("snapshot_id", key, order)]
    seq = complete_snapshots(snapshots, kind)
    hashes = F.array(*[F.xxhash64(squeeze(F.col(f"`{c}`").cast("string"))) for c in values]) if values else F.array().cast("array<bigint>")
    tagged = rows.where(F.col(key).isNotNull()).select(
        "snapshot_id", F.col(key).alias("__key"), F.col(order).alias("__order"), hashes.alias("__values")
    )
    last = (
        tagged.join(seq, "snapshot_id")
        .groupBy("seq", "total", "__key")
        .agg(F.max_by("__values", F.struct(F.coalesce(F.col("__order").cast("long"), F.lit(-(2**63) + 1)), "__values")).alias("__values"))
    )
    keys = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("__key"))
    ordinals = stored_ordinals(keys, "__key", ordinal_folder) if ordinal_folder else extend_ordinals(keys, "__key", known)
    placed = last.join(ordinals, "__key")
    seq_no = F.col("seq")
    # a row takes part as the current one in its own run and as the former one in the run of seq + 1
    runs = F.array_distinct(F.array(F.floor(seq_no / RUN), F.floor((seq_no + 1) / RUN)))
    placed = placed.select(
        F.shiftright("ordinal", CONTAINER_BITS).alias("container"),
        F.explode(runs).alias("run"),
        F.col("ordinal").bitwiseAND(CONTAINER - 1).cast("int").alias("position"),
        seq_no.cast("int").alias("seq"),
        "total",
        "__key",
        "__values",
    )
    schema = T.StructType(
        [T.StructField("seq", T.IntegerType()), T.StructField("__key", rows.schema[key].dataType), T.StructField("change", T.StringType())]
    )
    found = placed.groupBy("container", "run").applyInPandas(_compare_run, schema)
    return found.join(seq.drop("total"), "seq").select("snapshot_id", F.col("__key").alias(key), "change")


def _compare_run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    run = int(key[1])
    position = pdf["position"].to_numpy(np.int64)
    names = np.empty(CONTAINER, dtype=object)
    names[position] = pdf["__key"].to_numpy()
    width = len(pdf["__values"].iloc[0])
    values = np.array(pdf["__values"].tolist(), dtype=np.int64).reshape(len(pdf), width)
    total = int(pdf["total"].iloc[0])
    by_seq = {int(s): i for s, i in pdf.groupby("seq").indices.items()}

    def at(s: int) -> tuple[Bitmap, np.ndarray]:
        index = by_seq.get(s, np.empty(0, dtype=np.int64))
        vectors = np.zeros((CONTAINER, width), dtype=np.int64)
        vectors[position[index]] = values[index]
        return Bitmap(position[index]), vectors

    out: list[pd.DataFrame] = []
    first = max(1, run * RUN)
    before = at(first - 1)
    for s in range(first, min(total, (run + 1) * RUN)):
        now = at(s)
        common = now[0].and_(before[0]).astype(np.int64)
        differs = common[(now[1][common] != before[1][common]).any(axis=1)] if width else common[:0]
        for change, where in (("added", now[0].and_not(before[0])), ("removed", before[0].and_not(now[0])), ("changed", differs)):
            if len(where):
                out.append(pd.DataFrame({"seq": np.int32(s), "__key": names[where.astype(np.int64)], "change": change}))
        before = now
    return pd.concat(out) if out else pd.DataFrame({"seq": np.empty(0, np.int32), "__key": np.empty(0, object), "change": np.empty(0, object)})


def membership_bounds(rows: DataFrame, snapshots: DataFrame, key: str = "security_id", kind: str = "universe") -> DataFrame:
    """First and last complete snapshot of each key and whether the newest one has it.

    These are the figures that a store's own bookkeeping (first_seen, last_seen, active) should hold.
    """
    seq = complete_snapshots(snapshots, kind)
    return (
        rows.where(F.col(key).isNotNull())
        .select("snapshot_id", key)
        .join(seq, "snapshot_id")
        .groupBy(key)
        .agg(
            F.min_by("snapshot_id", "seq").alias("first_snapshot"),
            F.max_by("snapshot_id", "seq").alias("last_snapshot"),
            F.max(F.col("seq") == F.col("total") - 1).alias("in_newest"),
        )
    )
