"""Mixing sources to target weights (problem 9): Poisson replication.

Each distinct text gets a number of copies by inverting, at a uniform number hashed from its content and a seed, a Poisson
distribution cut off at the source's cap, whose rate is solved so that the mean is the source's repetition rate. The copies are
exploded and put into a global random order by hash. Counts depend on nothing but text, source and seed, so any executor
that repeats a task draws the same corpus.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweir.llm.tokens import TOKENIZER, count_tokens
from tallyweir.session import checkpointed, ship_package

MAX_SOURCES = 10_000  # targets that one call takes; more are refused
MAY_FALL_SHORT = 0.05  # of all shares: that much may lie with sources too scarce for the corpus
SEED = 20_240_601


def _terms(rate: float, cap: int) -> np.ndarray:
    """Probabilities of 0 .. cap - 1 under a Poisson of ``rate``, from logarithms, so that no rate is too large."""
    k = np.arange(cap)
    factorials = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, cap))))) if cap else np.empty(0)
    return np.exp(k * math.log(rate) - rate - factorials) if rate > 0 else (k == 0).astype(float)


def _mean(rate: float, cap: int) -> float:
    """Mean of min(Poisson(rate), cap)."""
    p = _terms(rate, cap)
    return float(p @ np.arange(cap) + cap * (1 - p.sum()))


def capped_poisson(mean: float, cap: int) -> list[float]:
    """Cumulative probabilities of 0 .. cap - 1 copies for a capped Poisson of the given mean; all 0 if every text gets the cap."""
    if cap <= 0 or mean <= 0:
        return [1.0] * max(cap, 1)
    if mean >= cap * (1 - 1e-9):
        return [0.0] * cap
    low, high = 0.0, 1.0
    while _mean(high, cap) < mean:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if _mean(middle, cap) < mean else (low, middle)
    return np.minimum(np.cumsum(_terms((low + high) / 2, cap)), 1.0).tolist()


def plan_rates(sizes: dict[str, int], targets: dict[str, tuple[float, int]], total: float | None = None, may_fall_short: float = MAY_FALL_SHORT) -> dict[str, float]:
    """Mean copies of a text for each source.

    A source that can't reach its share of ``total`` under its cap gives all it can, and the others keep their share of ``total``. Without
    ``total`` the corpus is the largest in which sources with all but ``may_fall_short`` of the shares reach theirs: a few scarce
    sources of little weight don't cut down all others.
    """
    present = {s: t for s, t in targets.items() if sizes.get(s, 0) > 0 and t[0] > 0 and t[1] > 0}
    if total is None:
        total, short = 0.0, 0.0
        for most, share in sorted((cap * sizes[s] / share, share) for s, (share, cap) in present.items()):
            total = most
            short += share
            if short > may_fall_short * sum(share for share, _ in present.values()) + 1e-12:
                break
    return {s: min(float(cap), share * total / sizes[s]) for s, (share, cap) in present.items()}


def mix_sources(documents: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", total_tokens: float | None = None, seed: int = SEED, tokenizer: str = TOKENIZER, may_fall_short: float = MAY_FALL_SHORT) -> DataFrame:
    """(doc_id, source, n_tokens, repeats, mean_repeats): the chosen texts with their number of copies and its mean over the source.

    Null and blank texts, null sources and sources without target are not drawn. A text that several rows hold counts once, for the
    smallest source and id, so that no text exceeds its cap. Sources that are absent have no row; see ``mix_shares``.
    """
    ship_package(documents.sparkSession)
    given = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap")).limit(MAX_SOURCES + 1).collect()
    if len(given) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources")
    wanted = {r["source"]: (float(r["share"] or 0.0), int(r["cap"] or 0)) for r in given}
    # copies of a text meet as hashes, combined before the exchange; the size is the text's own, so no join brings it back
    hashed = documents.where(F.col(source).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.sha2(text, 256).alias("text_sha"), F.col(text).alias("text"))
    counted = count_tokens(hashed, "doc_id", "text", tokenizer, keep=("source", "text_sha"))
    sized = counted.groupBy("text_sha").agg(F.min(F.struct("source", "doc_id")).alias("who"), F.max("n_tokens").alias("n_tokens"))
    sized = checkpointed(sized.select("text_sha", "who.source", "who.doc_id", "n_tokens"))
    # one sum per source; sources without target are few or many, but only those with one are asked for
    sums = sized.where(F.col("source").isin(*wanted)).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect() if wanted else []
    rates = plan_rates({r["source"]: r["n"] for r in sums}, wanted, total_tokens, may_fall_short)
    if not rates:
        return sized.limit(0).select(F.col("doc_id").alias(doc_id), F.col("source").alias(source), "n_tokens", F.lit(0).alias("repeats"), F.lit(0.0).alias("mean_repeats"))
    steps = F.create_map(*[x for s, mean in rates.items() for x in (F.lit(s), F.array(*map(F.lit, capped_poisson(mean, wanted[s][1]))))])
    # a uniform number from the text's hash: the same text draws the same, whatever row brings it
    uniform = (F.pmod(F.xxhash64("text_sha", F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / float(1 << 52)
    copies = F.size(F.filter(steps[F.col("source")], lambda p: p <= uniform))
    drawn = sized.where(F.col("source").isin(*rates)).withColumn("repeats", copies.cast("int")).where(F.col("repeats") > 0)
    means = F.create_map(*[F.lit(x) for kv in rates.items() for x in kv])
    return drawn.select(F.col("doc_id").alias(doc_id), F.col("source").alias(source), "n_tokens", "repeats", means[F.col("source")].alias("mean_repeats"))


def shuffled_copies(mixed: DataFrame, doc_id: str = "doc_id", seed: int = SEED) -> DataFrame:
    """One row per copy (copy_no from 1) with ``shuffle_key``, sorted by it: a global random order that ranges of the key split evenly."""
    copies = mixed.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("repeats"))))
    return copies.withColumn("shuffle_key", F.xxhash64(doc_id, "copy_no", F.lit(seed + 1))).drop("repeats", "mean_repeats").orderBy("shuffle_key", doc_id, "copy_no")


def mix_shares(mixed: DataFrame, targets: DataFrame, source: str = "source") -> DataFrame:
    """(source, target_share, max_repeats, n_texts, n_copies, mean_repeats, tokens, actual_share) for every target source, absent ones with 0.

    ``mean_repeats`` is the planned mean; one that equals ``max_repeats`` tells a source too scarce for its share.
    """
    got = mixed.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n_texts"), F.sum("repeats").alias("n_copies"), F.max("mean_repeats").alias("mean_repeats"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"))
    every = targets.select("source", "target_share", "max_repeats").join(got, "source", "left")
    # one row per source
    total = F.sum("tokens").over(Window.partitionBy(F.lit(1)))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_texts", "n_copies", "mean_repeats", "tokens")]
    return every.select("source", "target_share", "max_repeats", *counts, F.round(F.coalesce(F.col("tokens") / total, F.lit(0.0)), 6).alias("actual_share"))
