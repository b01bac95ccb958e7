"""Corpus statistics: document frequency, lift, words in context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweir.functions.text import term_pattern


def term_flags(text: Column, terms: list[str]) -> Column:
    """Array of the terms that a text holds as whole words. Terms are a given list; the text is scanned once per term, JVM-side."""
    wide = text.rlike("[Ａ-Ｚａ-ｚ０-９]")

    def hit(term: str) -> Column:
        # a plain search for what every match holds goes before the pattern
        first = term.split()[0].lower()
        there = F.contains(F.lower(text), F.lit(first)) | wide if first.isascii() else F.contains(text, F.lit(first[0]))
        return F.when(there & text.rlike(term_pattern(term)), F.lit(term))

    return F.array_compact(F.array(*map(hit, terms)))


def doc_freq(docs: DataFrame, text: str, terms: list[str]) -> DataFrame:
    """(term, df) for every given term, absent ones with 0."""
    spark = docs.sparkSession
    hit = docs.select(F.explode(term_flags(F.col(text), terms)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    given = spark.createDataFrame([(t,) for t in terms], "term string")
    return given.join(hit, "term", "left").select("term", F.coalesce("df", F.lit(0)).cast("long").alias("df"))


def lift(docs: DataFrame, text: str, relevant: Column, terms: list[str]) -> DataFrame:
    """(term, hits, lift): relevant share among a term's documents over the relevant share of all; null without hits or base."""
    flagged = docs.select(term_flags(F.col(text), terms).alias("t"), F.coalesce(relevant, F.lit(False)).cast("double").alias("r"))
    base = flagged.agg(F.avg("r")).first()[0]
    hits = flagged.select(F.explode("t").alias("term"), "r").groupBy("term").agg(F.count("*").alias("hits"), F.avg("r").alias("share"))
    return hits.select("term", "hits", F.round(F.col("share") / F.lit(base or None).cast("double"), 6).alias("lift"))


def word_counts(docs: DataFrame, text: str, pattern: str = r"[a-z]{2,}") -> DataFrame:
    """(word, df, cf): documents and occurrences of each word, counted per document before the exchange."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(f"({pattern})"), F.lit(1))
    marked = docs.select(F.monotonically_increasing_id().alias("d"), words.alias("words"))
    per = marked.select("d", F.explode("words").alias("word")).groupBy("d", "word").agg(F.count("*").alias("n"))
    return per.groupBy("word").agg(F.count("*").alias("df"), F.sum("n").alias("cf"))
