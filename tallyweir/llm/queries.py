"""Queries of the problems on text: 2, 4, 5, 7, 8, 9 and 10."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweir.llm.aliases import resolve, same_pairs
from tallyweir.llm.linking import match_profiles
from tallyweir.llm.mixing import mix_shares, mix_sources, shuffled_copies
from tallyweir.llm.packing import pack_documents, packing_report
from tallyweir.llm.prose import prose_probability
from tallyweir.llm.scans import page_noise, repaired_paragraphs
from tallyweir.llm.sentences import sentence_ends
from tallyweir.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = match_profiles(table(spark, sf_dir, "profile_rows"), table(spark, sf_dir, "securities"))
    return matched.select("security_id", "listing_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_noise(table(spark, sf_dir, "page_texts"))


def p4_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_paragraphs(table(spark, sf_dir, "page_texts"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_ends(table(spark, sf_dir, "items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_pairs(resolve(table(spark, sf_dir, "aliases")))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose_probability(table(spark, sf_dir, "documents")).where(F.col("not_prose") > 0.5).select("doc_id").distinct()


def p8_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_limits"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = table(spark, sf_dir, "pack_limits")
    return packing_report(pack_documents(table(spark, sf_dir, "documents"), limits), limits)


def p9_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shuffled_copies(mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "mix_targets")
    return mix_shares(mix_sources(table(spark, sf_dir, "documents"), targets), targets)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p2_found, p4_found, p4_paragraphs, p5_found, p7_found, p8_packets, p8_report, p9_corpus, p9_shares, p10_found)
}
ORACLE: dict[str, str] = {}
