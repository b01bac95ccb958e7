"""Queries for the engine's own operators over whole tables, each with the same query in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweir.functions import text as tx
from tallyweir.functions.blanks import BLANK_CLASS
from tallyweir.operators import corpus, evaluate, inference, ranking
from tallyweir.operators import relational as rel
from tallyweir.operators.snapshots import membership_bounds
from tallyweir.session import table
from tallyweir.sources import files
from tallyweir.streaming import events as ev

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL where it has one."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


ROW = "CAST(row_number() OVER ({}) AS INTEGER)"

# --- relations: lines, latest facts, universes ------------------------------------------------------------------------


@query("""
WITH m AS (SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY as_of DESC, obs_id DESC) r FROM market_daily WHERE as_of IS NOT NULL),
lines AS (SELECT s.company_key, s.security_id, s.name, s.country, m.market_cap_usd, m.as_of FROM securities s LEFT JOIN (SELECT * FROM m WHERE r = 1) m USING (security_id)),
one AS (SELECT *, row_number() OVER (PARTITION BY company_key ORDER BY market_cap_usd DESC NULLS LAST, security_id) r FROM lines WHERE company_key IS NOT NULL)
SELECT CAST(row_number() OVER (ORDER BY market_cap_usd DESC NULLS LAST, security_id) AS INTEGER) AS rank, company_key, security_id, name, country, CAST(as_of AS VARCHAR) AS as_of, market_cap_usd
FROM one WHERE r = 1 ORDER BY rank LIMIT 40
""")
def universe_topk(spark: SparkSession, d: str) -> DataFrame:
    """The forty largest companies: latest fact per line, one line per company, a total order. Top 40 is the report's feature."""
    latest = rel.latest_by(table(spark, d, "market_daily"), ["security_id"], ["as_of", "obs_id"], ["security_id", "as_of", "obs_id", "market_cap_usd"])
    lines = table(spark, d, "securities").select("company_key", "security_id", "name", "country").join(latest.drop("obs_id"), "security_id", "left")
    order = [F.desc_nulls_last("market_cap_usd"), F.col("security_id")]
    one = rel.first_per_key(lines.where(F.col("company_key").isNotNull()), ["company_key"], order)
    top = one.orderBy(*order).limit(40)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("rank", "company_key", "security_id", "name", "country", F.col("as_of").cast("string").alias("as_of"), "market_cap_usd")


@query("""
SELECT company_key, security_id, name FROM (SELECT *, row_number() OVER (PARTITION BY company_key ORDER BY is_primary DESC NULLS LAST, security_id) r FROM securities WHERE company_key IS NOT NULL) WHERE r = 1
""")
def universe_dedupe(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "securities").where(F.col("company_key").isNotNull()).select("company_key", "security_id", "name", "is_primary")
    return rel.first_per_key(lines, ["company_key"], [F.desc_nulls_last("is_primary"), F.col("security_id")]).drop("is_primary")


@query("""
SELECT security_id, CAST(as_of AS VARCHAR) AS as_of, obs_id, close_price FROM (SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY as_of DESC, obs_id DESC) r FROM market_daily WHERE as_of IS NOT NULL) WHERE r = 1
""")
def latest_fact(spark: SparkSession, d: str) -> DataFrame:
    return rel.latest_by(table(spark, d, "market_daily"), ["security_id"], ["as_of", "obs_id"], ["security_id", "as_of", "obs_id", "close_price"]).withColumn("as_of", F.col("as_of").cast("string"))


@query("""
SELECT CASE WHEN m.market_cap_usd IS NULL THEN 'no_value' WHEN m.market_cap_usd < 1e8 THEN 'below_floor' WHEN m.volume IS NULL OR m.volume <= 0 THEN 'no_volume' ELSE 'kept' END AS stage,
count(*) AS n, count(m.market_cap_usd) AS with_value FROM market_daily m GROUP BY 1
""")
def funnel_counts(spark: SparkSession, d: str) -> DataFrame:
    cap, volume = F.col("market_cap_usd"), F.col("volume")
    stage = F.when(cap.isNull(), "no_value").when(cap < 1e8, "below_floor").when(volume.isNull() | (volume <= 0), "no_volume").otherwise("kept")
    return table(spark, d, "market_daily").groupBy(stage.alias("stage")).agg(F.count("*").alias("n"), F.count("market_cap_usd").alias("with_value"))


@query("""
SELECT security_id, CASE WHEN name IS NULL THEN 'unnamed' WHEN isin IS NULL THEN 'no_isin' WHEN length(isin) <> 12 THEN 'bad_isin' WHEN country IS NULL THEN 'no_country' ELSE 'complete' END AS stage FROM securities
""")
def funnel_ledger(spark: SparkSession, d: str) -> DataFrame:
    stage = F.when(F.col("name").isNull(), "unnamed").when(F.col("isin").isNull(), "no_isin").when(F.length("isin") != 12, "bad_isin").when(F.col("country").isNull(), "no_country").otherwise("complete")
    return table(spark, d, "securities").select("security_id", stage.alias("stage"))


@query("""
SELECT metric, obs_id, value FROM (SELECT obs_id, close_price, volume, market_cap_usd FROM market_daily) m, LATERAL (VALUES ('close_price', m.close_price), ('volume', m.volume), ('market_cap_usd', m.market_cap_usd)) v(metric, value)
""")
def eav_unpivot(spark: SparkSession, d: str) -> DataFrame:
    return rel.unpivot_keep_nulls(table(spark, d, "market_daily"), ["obs_id"], ["close_price", "volume", "market_cap_usd"])


@query("""
SELECT o_custkey, y1 AS newest_year, CASE WHEN v1 > 0 AND v0 > 0 THEN round(pow(v1 / v0, 1.0 / 3) - 1, 6) END AS cagr FROM (
  SELECT a.o_custkey, a.y1, a.v1, b.v AS v0 FROM (SELECT o_custkey, max(y) AS y1, arg_max(v, y) AS v1 FROM r GROUP BY 1) a LEFT JOIN r b ON b.o_custkey = a.o_custkey AND b.y = a.y1 - 3)
""".replace("FROM (\n", "FROM (\n", 1).replace("SELECT o_custkey, y1", "WITH r AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS y, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2) SELECT o_custkey, y1", 1))
def cagr_3y(spark: SparkSession, d: str) -> DataFrame:
    yearly = table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.sum("o_totalprice").alias("v"))
    return rel.cagr(yearly, ["o_custkey"], "y", "v").withColumn("cagr", F.round("cagr", 6))


@query("""
SELECT m.obs_id, CASE WHEN m.market_cap_usd > 0 AND m.market_cap_local > 0 THEN round(m.market_cap_usd / m.market_cap_local, 6) END AS ratio FROM market_daily m
""")
def fx_ratio(spark: SparkSession, d: str) -> DataFrame:
    usd, local = F.col("market_cap_usd"), F.col("market_cap_local")
    return table(spark, d, "market_daily").select("obs_id", F.when((usd > 0) & (local > 0), F.round(usd / local, 6)).alias("ratio"))


@query("""
WITH h AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_quantity) AS p, list(l_quantity ORDER BY l_linenumber, l_partkey, l_quantity) AS q FROM lineitem GROUP BY 1),
z AS (SELECT l_orderkey, unnest(p) AS period, unnest(q) AS value FROM h)
SELECT l_orderkey, count(*) AS n, round(sum(value), 2) AS total FROM z WHERE period IS NOT NULL GROUP BY 1
""")
def array_zip_history(spark: SparkSession, d: str) -> DataFrame:
    """Parallel arrays of an order's few lines, zipped again."""
    point = F.struct("l_linenumber", "l_partkey", "l_quantity")
    history = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(point)).alias("h"))
    pairs = history.select("l_orderkey", F.explode(rel.zip_history(F.col("h.l_partkey"), F.col("h.l_quantity"))).alias("x"))
    return pairs.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("x.value"), 2).alias("total"))


@query("""
SELECT security_id, coalesce(n.name, o.name) AS name, coalesce(n.country, CASE WHEN n.security_id IS NULL THEN o.country END) AS country, n.security_id IS NOT NULL AS active
FROM (SELECT security_id, name, country FROM securities) o FULL JOIN (SELECT security_id, max(name) AS name, max(country) AS country FROM universe_rows GROUP BY 1) n USING (security_id)
""")
def soft_deactivate(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "securities").select("security_id", "name", "country")
    new = table(spark, d, "universe_rows").groupBy("security_id").agg(F.max("name").alias("name"), F.max("country").alias("country"))
    return rel.soft_upsert(old, new, ["security_id"])


@query("""
SELECT coalesce(a.security_id, b.security_id) AS security_id, a.n AS rows_market, b.n AS rows_universe FROM (SELECT security_id, count(*) AS n FROM market_daily GROUP BY 1) a FULL JOIN (SELECT security_id, count(*) AS n FROM universe_rows GROUP BY 1) b ON a.security_id = b.security_id
""")
def full_outer_merge(spark: SparkSession, d: str) -> DataFrame:
    a, b = (table(spark, d, t).groupBy("security_id").agg(F.count("*").alias(n)) for t, n in (("market_daily", "rows_market"), ("universe_rows", "rows_universe")))
    return a.join(b, "security_id", "full")


@query("""
SELECT DISTINCT p.listing_id, s.security_id FROM profile_rows p JOIN securities s ON p.id_isin = s.isin OR p.ticker_base = s.symbol
""")
def or_join_profiles(spark: SparkSession, d: str) -> DataFrame:
    return rel.or_equi_join(table(spark, d, "profile_rows"), table(spark, d, "securities"), [("id_isin", "isin"), ("ticker_base", "symbol")], "listing_id", "security_id")


@query("SELECT s.security_id, EXISTS (SELECT 1 FROM documents x WHERE x.security_id = s.security_id) AS has_text FROM securities s")
def exists_flag(spark: SparkSession, d: str) -> DataFrame:
    return rel.exists_flag(table(spark, d, "securities").select("security_id"), table(spark, d, "documents"), "security_id", "has_text")


@query("SELECT s.security_id FROM securities s WHERE NOT EXISTS (SELECT 1 FROM items x WHERE x.security_id = s.security_id)")
def anti_join_queue(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "securities").select("security_id").join(table(spark, d, "items").select("security_id"), "security_id", "left_anti")


@query("""
SELECT s.security_id, count(DISTINCT x.doc_id) AS docs FROM securities s LEFT JOIN (SELECT doc_id, security_id AS k FROM documents UNION SELECT d.doc_id, t.security_id FROM documents d JOIN securities t ON d.company_key = t.company_key) x ON x.k = s.security_id GROUP BY 1
""")
def bridge_join_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents of a line, attached directly or through its company.

    Documents are counted by company before they meet its lines, so no pair of document and line is made; those attached directly count
    beside them where they belong to another company.
    """
    docs, lines = table(spark, d, "documents").select("doc_id", "security_id", "company_key"), table(spark, d, "securities").select("security_id", "company_key")
    by_company = docs.where(F.col("company_key").isNotNull()).groupBy("company_key").agg(F.count_distinct("doc_id").alias("shared"))
    direct = docs.where(F.col("security_id").isNotNull()).select("doc_id", "security_id", F.col("company_key").alias("theirs")).join(lines, "security_id")
    own = direct.where(~F.coalesce(F.col("theirs") == F.col("company_key"), F.lit(False))).groupBy("security_id").agg(F.count_distinct("doc_id").alias("own"))
    met = lines.join(by_company, "company_key", "left").join(own, "security_id", "left")
    return met.select("security_id", (F.coalesce("shared", F.lit(0)) + F.coalesce("own", F.lit(0))).alias("docs"))


@query("""
WITH e AS (SELECT p.listing_id, s.security_id FROM profile_rows p JOIN securities s ON p.ticker_base = s.symbol),
f AS (SELECT p.listing_id, s.security_id FROM (SELECT * FROM profile_rows WHERE listing_id NOT IN (SELECT listing_id FROM e)) p JOIN securities s ON ltrim(regexp_replace(p.ticker_base, '[^A-Z0-9]', '', 'g'), '0') = ltrim(regexp_replace(s.symbol, '[^A-Z0-9]', '', 'g'), '0'))
SELECT listing_id, security_id, 'exact' AS tier FROM e UNION ALL SELECT listing_id, security_id, 'normalised' FROM f
""")
def tiered_ticker_join(spark: SparkSession, d: str) -> DataFrame:
    p, s = table(spark, d, "profile_rows").select("listing_id", "ticker_base"), table(spark, d, "securities").select("security_id", "symbol")
    exact = p.join(s, p["ticker_base"] == s["symbol"]).select("listing_id", "security_id", F.lit("exact").alias("tier"))
    bare = lambda c: F.ltrim(F.regexp_replace(c, "[^A-Z0-9]", ""), F.lit("0"))
    rest = p.join(exact.select("listing_id"), "listing_id", "left_anti").withColumn("k", bare(F.col("ticker_base")))
    loose = rest.join(s.withColumn("k", bare(F.col("symbol"))), "k").select("listing_id", "security_id", F.lit("normalised").alias("tier"))
    return exact.unionByName(loose)


@query("SELECT id_isin, count(DISTINCT listing_id) AS profiles FROM profile_rows WHERE id_isin IS NOT NULL GROUP BY 1 HAVING count(DISTINCT listing_id) > 1")
def ambiguous_matches(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "profile_rows").where(F.col("id_isin").isNotNull()).groupBy("id_isin").agg(F.count_distinct("listing_id").alias("profiles")).where(F.col("profiles") > 1)


@query("""
SELECT doc_id, sha FROM (SELECT doc_id, sha256(text) AS sha, row_number() OVER (PARTITION BY sha256(text) ORDER BY fetched_at, doc_id) r FROM documents WHERE text IS NOT NULL) WHERE r = 1
""")
def shared_text_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """The first holder of each text: hashes, not texts, cross the exchange."""
    hashed = table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", F.sha2("text", 256).alias("sha"), "fetched_at")
    return hashed.groupBy("sha").agg(F.min_by("doc_id", F.struct(F.col("fetched_at").isNull().cast("int"), "fetched_at", "doc_id")).alias("doc_id")).select("doc_id", "sha")


@query("""
SELECT company_key, doc_id, CAST(filing_date AS VARCHAR) AS filing_date FROM (SELECT *, row_number() OVER (PARTITION BY company_key ORDER BY filing_date DESC NULLS LAST, n_chars DESC NULLS LAST, doc_id) r FROM documents WHERE company_key IS NOT NULL) WHERE r = 1
""")
def document_choice(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(F.col("company_key").isNotNull()).select("company_key", "doc_id", "filing_date", "n_chars")
    return rel.first_per_key(docs, ["company_key"], [F.desc_nulls_last("filing_date"), F.desc_nulls_last("n_chars"), F.col("doc_id")]).select("company_key", "doc_id", F.col("filing_date").cast("string").alias("filing_date"))


@query("""
SELECT security_id, source, doc_id FROM (SELECT security_id, source, doc_id, row_number() OVER (PARTITION BY security_id, source ORDER BY length(text) DESC NULLS LAST, doc_id) r FROM documents WHERE security_id IS NOT NULL) WHERE r = 1
""")
def description_choice(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(F.col("security_id").isNotNull()).select("security_id", "source", "doc_id", F.length("text").alias("n"))
    return rel.first_per_key(docs, ["security_id", "source"], [F.desc_nulls_last("n"), F.col("doc_id")]).drop("n")


@query("""
WITH c AS (SELECT *, row_number() OVER (PARTITION BY company_key ORDER BY filing_date DESC, doc_id DESC) r FROM documents WHERE company_key IS NOT NULL AND filing_date IS NOT NULL)
SELECT a.company_key, a.doc_id, max(b.doc_id) AS companion FROM c a LEFT JOIN c b ON b.company_key = a.company_key AND b.source = a.source AND year(b.filing_date) = year(a.filing_date) AND b.doc_id <> a.doc_id WHERE a.r = 1 GROUP BY 1, 2
""")
def summary_companion(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(F.col("company_key").isNotNull() & F.col("filing_date").isNotNull()).select("company_key", "doc_id", "filing_date", "source", F.year("filing_date").alias("y"))
    newest = rel.latest_by(docs, ["company_key"], ["filing_date", "doc_id"])
    # the two greatest ids per group suffice to find the greatest other one, whatever the group's size
    other = docs.groupBy("company_key", "source", "y").agg(F.max("doc_id").alias("hi"))
    second = docs.join(other, ["company_key", "source", "y"]).where(F.col("doc_id") != F.col("hi")).groupBy("company_key", "source", "y").agg(F.max("doc_id").alias("lo"))
    both = newest.join(other, ["company_key", "source", "y"], "left").join(second, ["company_key", "source", "y"], "left")
    return both.select("company_key", "doc_id", F.when(F.col("hi") != F.col("doc_id"), F.col("hi")).otherwise(F.col("lo")).alias("companion"))


# --- coverage, licence, freshness -------------------------------------------------------------------------------------


@query("""
SELECT coalesce(s.country, 'unknown') AS country, count(*) AS lines, count(s.isin) AS with_isin, count(*) FILTER (WHERE x.security_id IS NOT NULL) AS with_text, count(*) FILTER (WHERE p.security_id IS NOT NULL) AS with_item
FROM securities s LEFT JOIN (SELECT DISTINCT security_id FROM documents) x USING (security_id) LEFT JOIN (SELECT DISTINCT security_id FROM items) p USING (security_id) GROUP BY 1
""")
def region_coverage(spark: SparkSession, d: str) -> DataFrame:
    flags = rel.exists_flag(rel.exists_flag(table(spark, d, "securities").select("security_id", "country", "isin"), table(spark, d, "documents"), "security_id", "t"), table(spark, d, "items"), "security_id", "i")
    return flags.groupBy(F.coalesce("country", F.lit("unknown")).alias("country")).agg(F.count("*").alias("lines"), F.count("isin").alias("with_isin"), F.count_if("t").alias("with_text"), F.count_if("i").alias("with_item"))


@query("SELECT coalesce(source, 'unknown') AS source, count(*) AS docs, count(DISTINCT company_key) AS companies, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1")
def coverage_by_source(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count("*").alias("docs"), F.count_distinct("company_key").alias("companies"), F.sum("n_chars").alias("chars"))


@query("SELECT source_id, coalesce(form, '?') AS form, count(*) AS n, count(DISTINCT filing_no) AS filings FROM filing_rows GROUP BY 1, 2")
def source_form_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "filing_rows").groupBy("source_id", F.coalesce("form", F.lit("?")).alias("form")).agg(F.count("*").alias("n"), F.count_distinct("filing_no").alias("filings"))


@query("""
SELECT coalesce(s.license_tier, 'unknown') AS tier, count(*) AS n, count(DISTINCT f.filing_no) AS filings FROM filing_rows f LEFT JOIN snapshots p USING (snapshot_id) LEFT JOIN sources s ON s.source_id = p.source_id GROUP BY 1
""")
def licence_tier_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "filing_rows").select("snapshot_id", "filing_no")
    tiers = table(spark, d, "snapshots").select("snapshot_id", "source_id").join(table(spark, d, "sources").select("source_id", "license_tier"), "source_id", "left")
    return rows.join(tiers, "snapshot_id", "left").groupBy(F.coalesce("license_tier", F.lit("unknown")).alias("tier")).agg(F.count("*").alias("n"), F.count_distinct("filing_no").alias("filings"))


@query("SELECT source_id, max(ingested_at) AS newest, min(ingested_at) AS oldest, count(*) AS n FROM filing_rows GROUP BY 1")
def freshness(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "filing_rows").groupBy("source_id").agg(F.max("ingested_at").alias("newest"), F.min("ingested_at").alias("oldest"), F.count("*").alias("n"))


@query("""
SELECT security_id, cap FROM (SELECT security_id, max(market_cap_usd) AS cap FROM market_daily GROUP BY 1) WHERE security_id NOT IN (SELECT security_id FROM items WHERE security_id IS NOT NULL) ORDER BY cap DESC NULLS LAST, security_id LIMIT 20
""")
def gap_topk(spark: SparkSession, d: str) -> DataFrame:
    """The twenty largest lines without an item; a top-20 report."""
    caps = table(spark, d, "market_daily").groupBy("security_id").agg(F.max("market_cap_usd").alias("cap"))
    return caps.join(table(spark, d, "items").select("security_id"), "security_id", "left_anti").orderBy(F.desc_nulls_last("cap"), "security_id").limit(20)


@query("SELECT security_id, count(DISTINCT year(filing_date)) AS years, list(DISTINCT CAST(year(filing_date) AS INTEGER) ORDER BY CAST(year(filing_date) AS INTEGER))::VARCHAR AS listed FROM documents WHERE filing_date IS NOT NULL AND security_id IS NOT NULL GROUP BY 1")
def distinct_years(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(F.col("filing_date").isNotNull() & F.col("security_id").isNotNull())
    years = F.array_sort(F.collect_set(F.year("filing_date")))
    return docs.groupBy("security_id").agg(years.alias("y")).select("security_id", F.size("y").cast("long").alias("years"), F.concat(F.lit("["), F.array_join("y", ", "), F.lit("]")).alias("listed"))


@query("""
SELECT security_id, first_snapshot, last_snapshot, last_seq = total - 1 AS in_newest FROM (
 SELECT u.security_id, arg_min(u.snapshot_id, s.seq) AS first_snapshot, arg_max(u.snapshot_id, s.seq) AS last_snapshot, max(s.seq) AS last_seq, max(s.total) AS total
 FROM universe_rows u JOIN (SELECT snapshot_id, row_number() OVER (ORDER BY fetched_at, snapshot_id) - 1 AS seq, count(*) OVER () AS total FROM snapshots WHERE kind = 'universe' AND status = 'ok') s USING (snapshot_id) GROUP BY 1)
""")
def snapshot_bounds(spark: SparkSession, d: str) -> DataFrame:
    return membership_bounds(table(spark, d, "universe_rows"), table(spark, d, "snapshots"))


_NORM = "nullif(trim(regexp_replace(CAST(COL AS VARCHAR), '" + BLANK_CLASS + "+', ' ', 'g')), '')"
_COLS = ("name", "isin", "country", "tv_type", "tv_subtype", "is_primary", "price_currency", "fundamental_currency", "sector", "industry")
ORACLE["p1_found"] = f"""
WITH s AS (SELECT snapshot_id, row_number() OVER (ORDER BY fetched_at, snapshot_id) AS seq FROM snapshots WHERE kind = 'universe' AND status = 'ok'),
r AS (SELECT s.seq, u.* FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id, security_id ORDER BY row_no DESC) rn FROM universe_rows) u JOIN s USING (snapshot_id) WHERE rn = 1),
n AS (SELECT seq, security_id, {", ".join(_NORM.replace("COL", c) + f" AS {c}" for c in _COLS)} FROM r)
SELECT s.snapshot_id, coalesce(b.security_id, a.security_id) AS security_id, CASE WHEN a.security_id IS NULL THEN 'added' WHEN b.security_id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM (SELECT seq + 1 AS seq, * EXCLUDE (seq) FROM n) a FULL JOIN n b ON a.seq = b.seq AND a.security_id = b.security_id JOIN s ON s.seq = coalesce(b.seq, a.seq)
WHERE s.seq > 1 AND (a.security_id IS NULL OR b.security_id IS NULL OR {" OR ".join(f"a.{c} IS DISTINCT FROM b.{c}" for c in _COLS)})
"""

# --- text -------------------------------------------------------------------------------------------------------------

_HAN, _KANA, _HANGUL, _LATIN = tx.HAN, tx.KANA, tx.HANGUL, tx.LATIN


def _n(c: str, p: str) -> str:
    return f"len(regexp_extract_all({c}, '{p}'))"


@query(f"SELECT doc_id, CAST({_n('text', _HAN)} AS INTEGER) AS han, CAST({_n('text', _KANA)} AS INTEGER) AS kana, CAST({_n('text', _HANGUL)} AS INTEGER) AS hangul, CAST({_n('text', _LATIN)} AS INTEGER) AS latin FROM documents WHERE text IS NOT NULL")
def script_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", *[c.alias(k) for k, c in tx.script_counts(F.col("text")).items()])


@query(f"""
WITH n AS (SELECT doc_id, {_n("t", _HAN)} AS h, {_n("t", _KANA)} AS k, {_n("t", _HANGUL)} AS g, {_n("t", _LATIN)} AS l FROM (SELECT doc_id, coalesce(substring(text, 1, 20000), '') AS t FROM documents))
SELECT doc_id, CASE WHEN h + k + g + l < 20 THEN NULL WHEN g >= greatest(10, 0.3 * (h + k + g)) AND g * 5 >= l THEN 'ko' WHEN h + k >= 10 AND (h + k) * 5 >= l THEN if(k >= 0.1 * (h + k), 'ja', 'zh') WHEN l >= 20 THEN 'en' END AS told FROM n
""")
def detect_language(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.detect_language(F.col("text")).alias("told"))


@query("""
SELECT doc_id, count(*) FILTER (WHERE length(p) >= 80) AS n, coalesce(CAST(sum(length(p)) FILTER (WHERE length(p) >= 80) AS BIGINT), 0) AS chars FROM (
  SELECT doc_id, trim(regexp_replace(unnest(CASE WHEN len(b) < 4 THEN string_split(text, chr(10)) ELSE b END), '\\s+', ' ', 'g')) AS p
  FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\\n[ \\t]*\\n'), lambda x: trim(x, ' ') <> '') AS b FROM documents WHERE text IS NOT NULL)) GROUP BY 1
""")
def paragraph_split(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", tx.paragraphs(F.col("text")).alias("p"))
    return docs.select("doc_id", F.size("p").cast("long").alias("n"), F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"))


_STOPS = r"""list_filter(range(1, length(h) + 1), lambda i: h[i] IN ('。', '！', '？') OR (h[i] IN ('!', '?', '.') AND regexp_matches(h[i + 1], '\s') AND NOT (h[i] = '.' AND regexp_matches(h[1:i], '(?:^|[ \n　])(?:[0-9]{1,3}|[A-Za-z]|[ivxIVX]{1,4}|[가나다라마바사아자차카타파하])\.$'))))"""


@query(rf"""
WITH f AS (SELECT doc_id, lang, trim(regexp_replace(text, '[ \t]+', ' ', 'g'), ' ') AS f FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, substring(f, 1, 119) AS h FROM f), e AS (SELECT *, list_max({_STOPS}) AS stop, length(regexp_extract(h, '(?s)^(.*) ', 1)) AS blank FROM h),
s AS (SELECT *, h[1:stop] || regexp_extract(h[stop + 1:], '^[」』）)]*') AS sentence, regexp_replace(CASE WHEN strpos(h, ' ') > 0 AND blank > 72 THEN h[1:blank] ELSE h END, '[ ,;:]+$', '') AS words FROM e)
SELECT doc_id, CASE WHEN length(f) <= 120 THEN f WHEN lang IN ('zh', 'ja', 'ko') THEN CASE WHEN length(sentence) > 72 THEN sentence WHEN lang <> 'ko' THEN rtrim(h, ' ') ELSE words END || '…' ELSE words || '…' END AS short FROM s
""")
def truncate_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", tx.truncate_words(F.col("text"), 120, F.col("lang")).alias("short"))


@query("SELECT item_id, substring(sha256(lower(trim(regexp_replace(text, '" + r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+" + "', ' ', 'g')))), 1, 16) AS sha FROM items WHERE text IS NOT NULL")
def text_norm_sha(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "items").where(F.col("text").isNotNull()).select("item_id", F.substring(F.sha2(tx.normalised(F.col("text")), 256), 1, 16).alias("sha"))


@query(r"SELECT item_id, substring(sha256(regexp_replace(text, '^\[[^\]\n]*\]\n', '')), 1, 16) AS sha FROM items WHERE text IS NOT NULL")
def evidence_sha(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "items").where(F.col("text").isNotNull()).select("item_id", tx.content_sha(F.col("text")).alias("sha"))


TERMS = ["pressure valve", "battery cell", "machine tool", "freight software", "surgical stapler", "lease", "patent", "turbine"]


def _matches(term: str, c: str = "text") -> str:
    return f"regexp_matches({c}, '{tx.term_pattern(term)}')"


@query("SELECT doc_id, term FROM (SELECT doc_id, unnest([" + ", ".join(f"CASE WHEN {_matches(t)} THEN '{t}' END" for t in TERMS) + "]) AS term FROM documents WHERE text IS NOT NULL) WHERE term IS NOT NULL")
def term_match(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", F.explode(corpus.term_flags(F.col("text"), TERMS)).alias("term"))


@query("SELECT t.term, count(d.doc_id) AS df FROM (VALUES " + ", ".join(f"('{t}')" for t in TERMS) + ") t(term) LEFT JOIN (" + " UNION ALL ".join(f"SELECT '{t}' AS term, doc_id FROM documents WHERE {_matches(t)}" for t in TERMS) + ") d USING (term) GROUP BY 1")
def doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return corpus.doc_freq(table(spark, d, "documents"), "text", TERMS)


@query(
    "WITH h AS ("
    + " UNION ALL ".join(f"SELECT '{t}' AS term, CAST(coalesce(source = 'annual_report', false) AS DOUBLE) AS r FROM documents WHERE {_matches(t)}" for t in TERMS)
    + ") SELECT term, count(*) AS hits, round(avg(r) / (SELECT avg(CAST(coalesce(source = 'annual_report', false) AS DOUBLE)) FROM documents), 6) AS lift FROM h GROUP BY 1"
)
def term_lift(spark: SparkSession, d: str) -> DataFrame:
    return corpus.lift(table(spark, d, "documents"), "text", F.col("source") == "annual_report", TERMS)


@query("""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS word FROM documents WHERE text IS NOT NULL)
SELECT word, count(DISTINCT doc_id) AS df, count(*) AS cf FROM w GROUP BY 1
""")
def word_counts(spark: SparkSession, d: str) -> DataFrame:
    return corpus.word_counts(table(spark, d, "documents").where(F.col("text").isNotNull()), "text")


@query("""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS word FROM documents WHERE text IS NOT NULL), n AS (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL)
SELECT word, count(DISTINCT doc_id) AS df FROM w, n GROUP BY word, n.n HAVING count(DISTINCT doc_id) >= 0.05 * n.n
""")
def noisy_terms(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(F.col("text").isNotNull())
    n = docs.count()
    return corpus.word_counts(docs, "text").where(F.col("df") >= 0.05 * n).select("word", "df")


@query(r"""
WITH b AS (SELECT security_id, list_distinct(list_transform(range(1, greatest(length(t), if(length(t) = 1, 2, 1))), lambda i: substring(t, i, 2))) AS g FROM (SELECT security_id, lower(regexp_replace(name, '[^\p{L}\p{M}\p{N}]', '', 'g')) AS t FROM securities)),
u AS (SELECT security_id, list_distinct(list_transform(range(1, greatest(length(t), if(length(t) = 1, 2, 1))), lambda i: substring(t, i, 2))) AS g FROM (SELECT security_id, lower(regexp_replace(max(name), '[^\p{L}\p{M}\p{N}]', '', 'g')) AS t FROM universe_rows GROUP BY 1))
SELECT b.security_id, round(CASE WHEN len(list_distinct(list_concat(b.g, u.g))) = 0 THEN 0 ELSE len(list_intersect(b.g, u.g)) / len(list_distinct(list_concat(b.g, u.g))) END, 6) AS similarity FROM b JOIN u USING (security_id)
""")
def bigram_jaccard(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "securities").select("security_id", tx.bigrams(F.col("name")).alias("a"))
    b = table(spark, d, "universe_rows").groupBy("security_id").agg(F.max("name").alias("n")).select("security_id", tx.bigrams(F.col("n")).alias("b"))
    return a.join(b, "security_id").select("security_id", F.round(tx.jaccard(F.col("a"), F.col("b")), 6).alias("similarity"))


_VISIBLE = r"regexp_replace(regexp_replace(text, '(?is)<script[^>]*>.*?</script\s*>|<style[^>]*>.*?</style\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g')"
for _entity, _sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _VISIBLE = f"replace({_VISIBLE}, '{_entity}', '{_sign}')"


@query(rf"SELECT doc_id, trim(regexp_replace({_VISIBLE}, '\s+', ' ', 'g')) AS visible FROM documents WHERE text IS NOT NULL")
def html_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", tx.html_text(F.col("text")).alias("visible"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


_PLANTED = "SELECT doc_id, concat_ws(' ', text, CASE WHEN doc_id % 50 = 0 THEN 'api_key=' || sha256(CAST(doc_id AS VARCHAR)) WHEN doc_id % 50 = 1 THEN 'write to office' || doc_id || '@mail.example' WHEN doc_id % 50 = 2 THEN 'Bearer ' || sha256(CAST(doc_id AS VARCHAR)) END) AS text FROM documents"


@query(r"SELECT doc_id, kind FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind FROM ({_PLANTED}) WHERE regexp_matches(text, '{p}')" for k, p in files.SECRET_PATTERNS.items()) + ")")
def secret_scan(spark: SparkSession, d: str) -> DataFrame:
    """All documents, with keys and addresses planted in three of fifty, as the tables hold none."""
    kind, key = F.col("doc_id") % 50, F.sha2(F.col("doc_id").cast("string"), 256)
    planted = F.when(kind == 0, F.concat(F.lit("api_key="), key)).when(kind == 1, F.concat(F.lit("write to office"), F.col("doc_id").cast("string"), F.lit("@mail.example"))).when(kind == 2, F.concat(F.lit("Bearer "), key))
    return files.secret_hits(table(spark, d, "documents").select("doc_id", F.concat_ws(" ", "text", planted).alias("text")), "doc_id", "text")


# --- inference --------------------------------------------------------------------------------------------------------


@query("""
SELECT user_id, arg_max(event_id, (ts, event_id)) FILTER (WHERE event_type = 'purchase') AS answer, arg_max(event_type, (ts, event_id)) AS last_status FROM events GROUP BY 1
""")
def answer_cache_latest_ok(spark: SparkSession, d: str) -> DataFrame:
    return inference.cached_answers(table(spark, d, "events"), "user_id", "event_type", "ts", "event_id", ok="purchase")


@query("SELECT count(*) AS misses FROM (SELECT DISTINCT user_id FROM events) u WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND e.event_type = 'purchase')")
def cache_miss_anti(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("user_id").distinct().join(e.where(F.col("event_type") == "purchase").select("user_id"), "user_id", "left_anti").agg(F.count("*").alias("misses"))


@query("SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS running_cost, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) <= 500 AS fits FROM events")
def budget_running_sum(spark: SparkSession, d: str) -> DataFrame:
    e = rel.running_budget(table(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], "value", 500)
    return e.select("user_id", "event_id", F.round("running_cost", 4).alias("running_cost"), (F.round("running_cost", 4) <= 500).alias("fits"))


@query("SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, count(*) AS n, round(sum(o_totalprice), 2) AS spend FROM orders GROUP BY 1")
def spend_by_day(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.to_date("o_orderdate").cast("string").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("spend"))


@query("""
WITH RECURSIVE r AS (SELECT item_id, coalesce(lang, '?') AS g, lang, coalesce(strlen(text), 0) AS b, row_number() OVER (PARTITION BY lang ORDER BY item_id, strlen(text)) AS n FROM items),
p AS (SELECT g, n, item_id, lang, 1 AS packet_no, 1 AS held, b AS filled FROM r WHERE n = 1
 UNION ALL SELECT r.g, r.n, r.item_id, r.lang, CASE WHEN p.held = 8 OR p.filled + r.b > 4000 THEN p.packet_no + 1 ELSE p.packet_no END, CASE WHEN p.held = 8 OR p.filled + r.b > 4000 THEN 1 ELSE p.held + 1 END, CASE WHEN p.held = 8 OR p.filled + r.b > 4000 THEN r.b ELSE p.filled + r.b END FROM p JOIN r ON r.g = p.g AND r.n = p.n + 1)
SELECT item_id, lang, packet_no FROM p
""")
def packet_assign(spark: SparkSession, d: str) -> DataFrame:
    """Packets of at most 8 items and 4,000 bytes in the order of the items of each language; items without language are a group of their own."""
    items = table(spark, d, "items").select("item_id", "lang", F.octet_length("text").alias("bytes"))
    return inference.packets(items, "lang", "item_id", "bytes", 8, 4_000).drop("bytes")


@query("""
WITH m AS (SELECT l_suppkey, l_returnflag AS label, round(avg(l_discount), 9) AS p_mean, round(stddev_pop(l_discount), 9) AS p_sd FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, label, p_mean, p_sd FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY p_mean DESC, CASE label WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) r FROM m) WHERE r = 1
""")
def reads_mean_sd(spark: SparkSession, d: str) -> DataFrame:
    return inference.mean_reads(table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "label"), "l_suppkey", "label", "l_discount", {"A": 0, "N": 1, "R": 2})


@query("""
SELECT o_orderkey, arg_max(label, (n, -ord)) AS label, max(n) AS n FROM (SELECT l_orderkey AS o_orderkey, l_returnflag AS label, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS ord, count(*) AS n FROM lineitem GROUP BY 1, 2, 3) GROUP BY 1
""")
def prob_argmax(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("label")).agg(F.count("*").alias("n"))
    order = F.when(F.col("label") == "A", 0).when(F.col("label") == "N", 1).otherwise(2)
    return counts.groupBy("o_orderkey").agg(F.max_by("label", F.struct("n", (-order).alias("o"))).alias("label"), F.max("n").alias("n"))


@query("""
WITH p AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') / count(*) AS f, count(*) FILTER (WHERE o_orderstatus = 'O') / count(*) AS o, count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) / count(*) AS p FROM orders GROUP BY 1)
SELECT o_custkey, f >= o AND f >= p AS valid FROM p
""")
def answer_validation(spark: SparkSession, d: str) -> DataFrame:
    shares = table(spark, d, "orders").groupBy("o_custkey").agg(*[(F.count_if(c) / F.count("*")).alias(k) for k, c in (("F", F.col("o_orderstatus") == "F"), ("O", F.col("o_orderstatus") == "O"), ("P", ~F.col("o_orderstatus").isin("F", "O")))])
    probs = F.create_map(*[x for k in ("F", "O", "P") for x in (F.lit(k), F.col(k))])
    return shares.select("o_custkey", inference.valid_answer(probs, F.lit("F"), ["F", "O", "P"]).alias("valid"))


# --- ranking and evaluation -------------------------------------------------------------------------------------------


@query("SELECT CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rank, o_orderkey FROM orders")
def total_rank(spark: SparkSession, d: str) -> DataFrame:
    return ranking.ranked(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")]).select("rank", "o_orderkey")


@query("SELECT c_nationkey, c_custkey, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) r FROM customer) WHERE r <= 5")
def top_per_group(spark: SparkSession, d: str) -> DataFrame:
    """The five best customers of each nation; a top-5 report."""
    return ranking.top_per_group(table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 5).drop("c_acctbal")


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS b, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_quantity) AS a FROM lineitem)
SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, 'moved' AS change, CAST(b AS INTEGER) AS rank_before, CAST(a AS INTEGER) AS rank_after FROM r WHERE a <> b
""")
def ranking_diff(spark: SparkSession, d: str) -> DataFrame:
    """Rows that two rankings within their supplier place differently. Line numbers repeat within orders, so part and figures are in the key."""
    key = ["l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]
    rows = table(spark, d, "lineitem").select(*key)
    by = lambda c, last: ranking.ranked(rows, [F.desc(c), *map(F.col, key[1:4]), F.col(last)], ["l_suppkey"]).select(*key, "rank")
    return ranking.ranking_diff(by("l_quantity", "l_extendedprice"), by("l_extendedprice", "l_quantity"), key)


@query("SELECT alias_id, coalesce(nullif(norm, ''), nullif(text, ''), nullif(market, '')) AS verdict FROM aliases")
def pins_precedence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "aliases").select("alias_id", ranking.first_verdict("norm", "text", "market").alias("verdict"))


@query("""
WITH r AS (SELECT l_suppkey, CASE l_returnflag WHEN 'A' THEN 'right' WHEN 'R' THEN 'edge' WHEN 'N' THEN CASE WHEN l_linenumber > 3 THEN 'wrong' END END AS label, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem),
e AS (SELECT r.*, k FROM r JOIN (VALUES (10), (40)) v(k) ON rank <= k)
SELECT l_suppkey, k, count(*) AS shown, count(label) AS labelled, round(count(*) FILTER (WHERE label = 'right') / nullif(count(label), 0), 4) AS precision, round(count(*) FILTER (WHERE label IN ('right', 'edge')) / nullif(count(label), 0), 4) AS lenient, round(count(label) / nullif(count(*), 0), 4) AS coverage FROM e GROUP BY 1, 2
""")
def precision_at_k(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("l_returnflag") == "A", "right").when(F.col("l_returnflag") == "R", "edge").when((F.col("l_returnflag") == "N") & (F.col("l_linenumber") > 3), "wrong")
    rows = ranking.ranked(table(spark, d, "lineitem").withColumn("label", label), [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], ["l_suppkey"])
    return evaluate.precision_at_k(rows, "l_suppkey", "rank", "label", [10, 40])


@query("""
WITH w AS (SELECT DISTINCT exchange AS g, security_id FROM securities WHERE is_primary), f AS (SELECT DISTINCT split_part(security_id, ':', 1) AS g, security_id FROM market_daily WHERE market_cap_usd > 1e9)
SELECT w.g AS exchange, count(*) AS wanted, count(f.security_id) AS found, round(count(f.security_id) / count(*), 4) AS recall FROM w LEFT JOIN f ON f.g = w.g AND f.security_id = w.security_id GROUP BY 1
""")
def must_include_recall(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "securities").where("is_primary").select("exchange", "security_id")
    rows = table(spark, d, "market_daily").where(F.col("market_cap_usd") > 1e9).select(F.substring_index("security_id", ":", 1).alias("exchange"), "security_id")
    return evaluate.recall_of(rows, wanted, "exchange", "security_id")


@query("""
SELECT coalesce(c_mktsegment, '_all') AS segment, coalesce(CAST(n_name AS VARCHAR), '_all') AS nation, count(*) AS n, floor((CAST(sum(CAST(c_acctbal AS DECIMAL(12, 2))) * 100 AS BIGINT) * 200.0 + count(*)) / (2 * count(*))) / 10000 AS mean FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (c_mktsegment, n_name)
""")
def tier_rollup(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    # exact sums: means of doubles added in another order differ at the edge of rounding
    cents = (F.sum(F.col("c_acctbal").cast("decimal(12,2)")) * 100).cast("bigint")
    mean = F.floor((cents * 200.0 + F.count("*")) / (2 * F.count("*"))) / 10000
    return joined.rollup("c_mktsegment", "n_name").agg(F.count("*").alias("n"), mean.alias("mean")).select(F.coalesce("c_mktsegment", F.lit("_all")).alias("segment"), F.coalesce("n_name", F.lit("_all")).alias("nation"), "n", "mean")


@query("""
WITH b AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS rank_before FROM supplier), n AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_nationkey, s_acctbal DESC, s_suppkey) AS rank_now FROM supplier)
SELECT s_suppkey, rank_before, rank_now, rank_now <= 10 AND rank_before > 10 AS backfill FROM b JOIN n USING (s_suppkey)
""")
def backfill_flag(spark: SparkSession, d: str) -> DataFrame:
    return ranking.backfilled(table(spark, d, "supplier"), [F.desc("s_acctbal"), F.col("s_suppkey")], [F.col("s_nationkey"), F.desc("s_acctbal"), F.col("s_suppkey")], 10, "s_suppkey")


@query()
def inclusion_probability(spark: SparkSession, d: str) -> DataFrame:
    """Seeded draws; tested against a brute-force simulation."""
    shares = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_discount").alias("p"), F.stddev_pop("l_discount").alias("sd"))
    return ranking.inclusion_probability(shares, "l_suppkey", "p", "sd", 10, draws=2_000)


@query("""
WITH r AS (SELECT l_suppkey, l_linestatus AS tier, CASE l_returnflag WHEN 'A' THEN 'right' WHEN 'R' THEN 'wrong' END AS label FROM lineitem),
t AS (SELECT tier, count(*) FILTER (WHERE label = 'right') / nullif(count(label), 0) AS p FROM r GROUP BY 1), a AS (SELECT count(*) FILTER (WHERE label = 'right') / nullif(count(label), 0) AS p FROM r)
SELECT l_suppkey, count(*) AS shown, round(sum(CASE WHEN label = 'right' THEN 1.0 WHEN label IS NOT NULL THEN 0.0 ELSE coalesce(t.p, a.p) END) / count(*), 6) AS estimate FROM r JOIN t USING (tier), a GROUP BY 1
""")
def estimated_precision(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("l_returnflag") == "A", "right").when(F.col("l_returnflag") == "R", "wrong")
    return evaluate.estimated_precision(table(spark, d, "lineitem").select("l_suppkey", F.col("l_linestatus").alias("tier"), label.alias("label")), "l_suppkey", "tier", "label")


@query("""
SELECT m.security_id, bool_or(m.volume IS NOT NULL) AS has_newest FROM market_daily m JOIN (SELECT security_id, max(as_of) AS as_of FROM market_daily GROUP BY 1) x USING (security_id, as_of) GROUP BY 1
""")
def ttm_latest_flag(spark: SparkSession, d: str) -> DataFrame:
    """Whether the newest day has a value, without falling back: one aggregation on (day, has value)."""
    best = F.max(F.struct("as_of", F.col("volume").isNotNull().alias("has"))).alias("m")
    return table(spark, d, "market_daily").where(F.col("as_of").isNotNull()).groupBy("security_id").agg(best).select("security_id", F.col("m.has").alias("has_newest"))


@query("SELECT c.c_custkey, coalesce((SELECT round(sum(o.o_totalprice), 2) FROM orders o WHERE o.o_custkey = c.c_custkey), 0) AS spent FROM customer c")
def spend_by_run(spark: SparkSession, d: str) -> DataFrame:
    spent = table(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("s"))
    return table(spark, d, "customer").join(spent, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("s", F.lit(0.0)).alias("spent"))


@query("SELECT item_id, coalesce(array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN {_matches(t)} THEN '{t}' END" for t in TERMS) + "], lambda x: x IS NOT NULL)), '; '), '') AS terms FROM items WHERE text IS NOT NULL")
def matched_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "items").where(F.col("text").isNotNull()).select("item_id", F.array_join(F.array_sort(corpus.term_flags(F.col("text"), TERMS)), "; ").alias("terms"))


@query("SELECT coalesce(CAST(exchange AS VARCHAR), '_all') AS exchange, coalesce(CAST(tv_type AS VARCHAR), '_all') AS tv_type, count(*) AS n, count(DISTINCT company_key) AS companies FROM securities GROUP BY CUBE (exchange, tv_type)")
def coverage_cube(spark: SparkSession, d: str) -> DataFrame:
    cube = table(spark, d, "securities").cube("exchange", "tv_type").agg(F.count("*").alias("n"), F.count_distinct("company_key").alias("companies"))
    return cube.select(F.coalesce("exchange", F.lit("_all")).alias("exchange"), F.coalesce("tv_type", F.lit("_all")).alias("tv_type"), "n", "companies")


# --- set operations ---------------------------------------------------------------------------------------------------


@query("(SELECT company_key FROM securities EXCEPT SELECT company_key FROM documents) UNION ALL (SELECT company_key FROM documents EXCEPT SELECT company_key FROM securities)")
def one_side_only_keys(spark: SparkSession, d: str) -> DataFrame:
    a, b = (table(spark, d, t).select("company_key").distinct() for t in ("securities", "documents"))
    return a.exceptAll(b).unionByName(b.exceptAll(a))


@query("SELECT security_id FROM documents WHERE security_id IS NOT NULL INTERSECT SELECT security_id FROM items WHERE security_id IS NOT NULL")
def both_sides_keys(spark: SparkSession, d: str) -> DataFrame:
    a, b = (table(spark, d, t).select("security_id").where(F.col("security_id").isNotNull()) for t in ("documents", "items"))
    return a.intersect(b)


@query("SELECT source_id, count(*) AS n FROM (SELECT source_id FROM filing_rows UNION ALL SELECT source_id FROM page_texts UNION ALL SELECT source_id FROM snapshots) GROUP BY 1")
def source_row_union(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, t).select("source_id") for t in ("filing_rows", "page_texts", "snapshots")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("source_id").agg(F.count("*").alias("n"))


# --- packs and streams ------------------------------------------------------------------------------------------------


@query("SELECT source, count(*) AS rows FROM documents GROUP BY 1")
def pack_rows(spark: SparkSession, d: str) -> DataFrame:
    return files.manifest(table(spark, d, "documents").select("doc_id", "source", "lang", "text"), "source").drop("content_sum")


@query()
def pack_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Row counts and order-free content sums; the sum is of this engine's own JSON form, so it has no SQL twin."""
    return files.manifest(table(spark, d, "documents").select("doc_id", "source", "lang", "text"), "source")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    return ev.tumbling_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, s
""")
def session_counts(spark: SparkSession, d: str) -> DataFrame:
    return ev.session_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("session_start", F.col("session_start").cast("timestamp_ntz"))


@query("""
SELECT user_id, min(ts) AS run_start, count(*) AS run_length FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts, event_id) AS g FROM events) WHERE event_type = 'error' GROUP BY user_id, g
""")
def consecutive_errors(spark: SparkSession, d: str) -> DataFrame:
    return ev.consecutive_errors(table(spark, d, "events"))


@query("""
SELECT event_id, coalesce(ts < max(CASE WHEN event_type = 'error' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + INTERVAL 24 HOUR, false) AS blocked FROM events
""")
def cooldown_windows(spark: SparkSession, d: str) -> DataFrame:
    return ev.cooldown(table(spark, d, "events")).select("event_id", "blocked")


@query("""
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS in_window, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) > 3 AS excess FROM events
""")
def rate_window(spark: SparkSession, d: str) -> DataFrame:
    return ev.rate_excess(table(spark, d, "events")).select("event_id", "in_window", "excess")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """The same counts by Structured Streaming: a file stream drained once into the checkpoint folder, then read."""
    import uuid

    from tallyweir.session import checkpoint_folder

    folder = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, d, "events").schema
    stream = ev.read_events(spark, d, schema, pattern="events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = ev.tumbling_counts(stream)
    # complete mode keeps no watermark's loss: every batch replaces the table under its own id
    write = counts.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{folder}/out"))
    write.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


# --- the star schema --------------------------------------------------------------------------------------------------


def _net() -> Column:
    """Discounted price summed exactly: the same figure whatever the order of the rows."""
    return F.sum(F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("double")


@query("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))) AS DOUBLE) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2
""")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), _net().alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("""
SELECT n_name, CAST(sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))) AS DOUBLE) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1
""")
def local_supplier_volume(spark: SparkSession, d: str) -> DataFrame:
    c, o, li, s, n, r = (table(spark, d, t) for t in ("customer", "orders", "lineitem", "supplier", "nation", "region"))
    joined = c.join(o, F.col("c_custkey") == F.col("o_custkey")).join(li, F.col("l_orderkey") == F.col("o_orderkey")).join(s, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    joined = joined.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("n_name").agg(_net().alias("revenue"))


@query("SELECT p_brand, p_type, count(DISTINCT l_suppkey) AS suppliers, round(sum(l_quantity), 2) AS quantity FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY 1, 2")
def brand_suppliers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").join(table(spark, d, "lineitem"), F.col("p_partkey") == F.col("l_partkey")).groupBy("p_brand", "p_type").agg(F.count_distinct("l_suppkey").alias("suppliers"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
