"""Batch inference around a pluggable classifier: content keys, cache, packets, budgets, repeated reads."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tallyweir.operators.ranking import numbered
from tallyweir.session import ship_package

RUN = 8_192  # items of a group that one task packs


def item_key(*parts: Column) -> Column:
    """A key of an item's content: the first 32 hex digits of the SHA-256 of its parts as JSON."""
    return F.substring(F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256), 1, 32)


def cached_answers(ledger: DataFrame, key: str, status: str, at: str, request: str, ok: str = "ok") -> DataFrame:
    """Per key the newest answer with status ``ok`` and the newest status of all: one exchange."""
    order = F.struct(at, request)
    return ledger.groupBy(key).agg(F.max_by(F.when(F.col(status) == ok, F.col(request)), F.when(F.col(status) == ok, order)).alias("answer"), F.max_by(status, order).alias("last_status"))


def packets(items: DataFrame, group: str, order: str, size: str, most: int, capacity: int, run: int = RUN) -> DataFrame:
    """``items`` with ``packet_no`` from 1 within their group, filled in order: a packet is closed before an item that would be one
    too many or take it above ``capacity``. An item above the capacity has a packet alone.

    A group is filled in runs of ``run`` items, each by itself, so that no task holds an unbounded group; a run's last packet may stay
    poorly filled. A null group is a group; items without size count as empty; rows of equal ``order`` are taken in any fixed order.
    """
    ship_package(items.sparkSession)
    placed = numbered(items.withColumn("__size", F.coalesce(F.col(size).cast("long"), F.lit(0))), [group], [F.col(order), F.col("__size")], "__at")
    placed = placed.withColumn("__run", F.floor((F.col("__at") - 1) / run))
    kept = StructType([*items.schema.fields, StructField("__run", LongType()), StructField("__no", LongType())])

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__at", kind="stable")
        no, held, filled, out = 1, 0, 0, []
        for s in pdf["__size"]:
            if held and (held == most or filled + s > capacity):
                no, held, filled = no + 1, 0, 0
            held, filled = held + 1, filled + s
            out.append(no)
        return pdf.assign(__no=out)[[f.name for f in kept]]

    filled = placed.groupBy(group, "__run").applyInPandas(fill, kept)
    # one row a run: what came before it in its group
    ends = filled.groupBy(group, "__run").agg(F.max("__no").alias("__last"))
    before = F.coalesce(F.sum("__last").over(Window.partitionBy(group).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ends.select(F.col(group).alias("__group"), F.col("__run").alias("__r"), before.alias("__before"))
    same = F.col(group).eqNullSafe(F.col("__group")) & (F.col("__run") == F.col("__r"))
    return filled.join(ends, same).select(*items.columns, (F.col("__before") + F.col("__no")).cast("int").alias("packet_no"))


def mean_reads(reads: DataFrame, key: str, label: str, p: str, order: dict[str, int]) -> DataFrame:
    """(key, label, p_mean, p_sd): mean probability per label over reads, and the winning label, ties to the earlier in ``order``."""
    rank = F.create_map(*[F.lit(x) for k, v in order.items() for x in (k, v)])
    mean = reads.groupBy(key, label).agg(F.round(F.avg(p), 9).alias("p_mean"), F.round(F.stddev_pop(p), 9).alias("p_sd"))
    return mean.groupBy(key).agg(F.max_by(F.struct(label, "p_mean", "p_sd"), F.struct("p_mean", -rank[F.col(label)])).alias("b")).select(key, f"b.{label}", "b.p_mean", "b.p_sd")


def classify(items: DataFrame, key: str, text: str, model: Callable[[list[str]], list[dict[str, float]]], batch: int = 8) -> DataFrame:
    """(key, probs): answers of ``model`` to the distinct items, asked in batches on the executors. Null texts are not asked."""
    ship_package(items.sparkSession)
    asked = items.where(F.col(text).isNotNull()).select(key, text).dropDuplicates([key])
    kind = items.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            answers: list = []
            for at in range(0, len(pdf), batch):
                answers += model(pdf[text].iloc[at : at + batch].tolist())
            yield pd.DataFrame({key: pdf[key], "probs": answers})

    return asked.mapInPandas(run, f"`{key}` {kind}, probs map<string,double>")


def valid_answer(probs: Column, choice: Column, labels: list[str], slack: float = 0.01) -> Column:
    """Whether an answer is usable: known labels, each probability in [0, 1], sum near 1, the choice among the most probable."""
    values = F.map_values(probs)
    return (
        (F.size(F.array_except(F.map_keys(probs), F.array(*map(F.lit, labels)))) == 0)
        & F.forall(values, lambda p: (p >= 0) & (p <= 1))
        & (F.abs(F.aggregate(values, F.lit(0.0), lambda a, p: a + p) - 1) <= slack)
        & (F.coalesce(probs[choice], F.lit(-1.0)) >= F.array_max(values))
    )
