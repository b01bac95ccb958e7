"""The store's relations as typed schemas with their keys, and tables brought into them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from tallyweir.operators.relational import latest_by, with_missing_columns

# Name -> (columns, key).
RELATIONS = {
    "sources": ("source_id string, name string, license_tier string, terms_url string, notes string", ("source_id",)),
    "snapshots": ("snapshot_id string, source_id string, kind string, fetched_at timestamp_ntz, request_json string, raw_sha256 string, raw_bytes bigint, row_count bigint, duration_s double, status string, note string", ("snapshot_id",)),
    "securities": ("security_id string, exchange string, symbol string, name string, isin string, country string, tv_type string, tv_subtype string, is_primary boolean, price_currency string, fundamental_currency string, sector string, industry string, company_key string, first_seen_snapshot string, last_seen_snapshot string, last_seen_at timestamp_ntz, active boolean", ("security_id",)),
    "market_daily": ("security_id string, as_of date, close_price double, price_currency string, volume double, avg_volume_10d double, market_cap_usd double, market_cap_local double, fx_local_to_usd double, shares_outstanding double, float_shares double, fetched_at timestamp_ntz, snapshot_id string", ("security_id", "as_of")),
    "fundamentals_current": ("security_id string, as_of date, metric string, period string, value_usd double, value_local double, currency_local string, fiscal_period_end date, snapshot_id string", ("security_id", "as_of", "metric", "period")),
    "fundamentals_annual": ("security_id string, fiscal_year int, metric string, value_local double, currency_local string, snapshot_id string", ("security_id", "fiscal_year", "metric")),
    "descriptions": ("security_id string, source_id string, company_key string, text string, text_sha256 string, lang string, source_url string, fetched_at timestamp_ntz, match_method string, match_score double, snapshot_id string", ("security_id", "source_id")),
    "documents": ("doc_id string, security_id string, company_key string, source_id string, form string, section string, accession string, filing_date date, report_date date, url string, raw_sha256 string, raw_bytes bigint, text string, text_sha256 string, text_chars bigint, extractor string, extract_note string, fetched_at timestamp_ntz, snapshot_id string", ("doc_id",)),
    "identifiers": ("security_id string, id_type string, id_value string, method string, snapshot_id string", ("security_id", "id_type")),
    "requests": ("request_id string, run_id string, layer string, payload_sha256 string, model string, items int, questions int, status string, http_status int, cost_usd double, cost_basis string, input_tokens bigint, output_tokens bigint, sent_at timestamp_ntz, completed_at timestamp_ntz, response_path string, error string", ("request_id",)),
    "items": ("item_key string, request_id string, run_id string, layer string, position int, status string, label string, probs_json string, error string, created_at timestamp_ntz, read_index int, confidence double", ("item_key", "request_id")),
    "screen_runs": ("run_id string, idea string, params_json string, started_at timestamp_ntz, finished_at timestamp_ntz, status string, universe_n int, l1_n int, l1_pass_n int, l2_n int, output_n int, cost_usd double, output_dir string, note string", ("run_id",)),
    "screen_results": ("run_id string, company_key string, security_id string, layer string, label string, probs_json string, p_top double, request_id string, input_source string, input_tier string, evidence_url string, evidence_excerpt string, status string, error string, reads_json string, p_pos double, p_pos_sd double", ("run_id", "company_key", "layer")),
    "crawl_state": ("source_id string, security_id string, status string, http_status int, attempts int, last_attempt_at timestamp_ntz, note string", ("source_id", "security_id")),
    "runs": ("run_id string, command string, started_at timestamp_ntz, finished_at timestamp_ntz, status string, requests int, note string", ("run_id",)),
    "translations": ("sha string, target_lang string, kind string, source_lang string, text string, provenance string, created_at timestamp_ntz", ("sha", "target_lang")),
}


def schema_of(relation: str) -> StructType:
    return _parse_datatype_string(RELATIONS[relation][0])


def empty(spark: SparkSession, relation: str) -> DataFrame:
    return spark.createDataFrame([], schema_of(relation))


def conform(df: DataFrame, relation: str) -> DataFrame:
    """``df`` with the relation's columns and types, absent ones null, others dropped. What can't be cast is null rather than an error."""
    wide = df.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema_of(relation) if f.name in df.columns])
    return with_missing_columns(wide, schema_of(relation)).select(*schema_of(relation).names)


def key_faults(df: DataFrame, relation: str) -> DataFrame:
    """(relation, rows, null_keys, repeated_keys): what keeps a table from being the relation's, in one aggregation by key and one over all."""
    keys = list(RELATIONS[relation][1])
    null = F.lit(False)
    for k in keys:
        null |= F.col(k).isNull()
    counted = df.groupBy(*keys).agg(F.count("*").alias("__n")).withColumn("__null", null)
    return counted.agg(F.lit(relation).alias("relation"), F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col("__null"), F.col("__n"))), F.lit(0)).alias("null_keys"), F.count_if((F.col("__n") > 1) & ~F.col("__null")).alias("repeated_keys")).select("relation", "rows", "null_keys", "repeated_keys")


def upsert(old: DataFrame, new: DataFrame, relation: str, order: list[str]) -> DataFrame:
    """The relation after a delivery: new rows replace old ones of their key, the newest by ``order`` among several; rows with a null key are left out."""
    keys = list(RELATIONS[relation][1])
    both = conform(old, relation).withColumn("__fresh", F.lit(0)).unionByName(conform(new, relation).withColumn("__fresh", F.lit(1)))
    there = both
    for k in keys:
        there = there.where(F.col(k).isNotNull())
    return latest_by(there, keys, ["__fresh", *order]).select(*schema_of(relation).names)
