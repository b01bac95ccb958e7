"""Sources and sinks: Parquet, CSV, JSON lines, whole text files, gated packs with a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PACK_FORMAT = 1


def read_ndjson(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): JSON lines of a given schema and the lines that are no such record."""
    wide = T.StructType([*schema.fields, T.StructField("__bad", T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    raw = lines.select("value", F.from_json("value", wide, {"columnNameOfCorruptRecord": "__bad", "mode": "PERMISSIVE"}).alias("r"))
    return raw.where(F.col("r.__bad").isNull()).select(*[F.col(f"r.{f.name}").alias(f.name) for f in schema]), raw.where(F.col("r.__bad").isNotNull()).select(F.col("value").alias("line"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType, **options: str) -> DataFrame:
    """Delimited text with a header, typed by a given schema, never inferred."""
    return spark.read.schema(schema).options(header="true", mode="PERMISSIVE", **options).csv(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_html_tables(pages: DataFrame, html: str, key: str) -> DataFrame:
    """(key, table_no, row_no, cells) of the rows of each page's tables, cells as plain text."""
    from tallyweir.functions.text import html_text

    tables = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<table[^>]*>(.*?)</table>"), F.lit(1))).alias("table_no", "body"))
    rows = tables.select(key, "table_no", F.posexplode(F.regexp_extract_all("body", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row_no", "body"))
    return rows.select(key, "table_no", "row_no", F.transform(F.regexp_extract_all("body", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), html_text).alias("cells"))


def row_sha(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``df`` with ``row_sha``, the SHA-256 of the row as JSON."""
    return df.withColumn("row_sha", F.sha2(F.to_json(F.struct(*(columns or df.columns)), {"ignoreNullFields": "false"}), 256))


def write_pack(df: DataFrame, licences: DataFrame, source: str, allowed: tuple[str, ...], path: str, files: int = 8) -> None:
    """Rows whose source has an allowed licence tier as gzip JSON lines, each with its hash. Rows of unknown sources stay out."""
    open_sources = licences.where(F.col("license_tier").isin(*allowed)).select(F.col("source_id").alias(source)).distinct()
    row_sha(df.join(open_sources, source, "left_semi").select(*df.columns)).repartition(files).write.mode("overwrite").option("compression", "gzip").option("ignoreNullFields", "false").json(path)


def read_pack(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, tampered): a pack's rows whose hash holds, and those whose doesn't."""
    raw = spark.read.schema(T.StructType([*schema.fields, T.StructField("row_sha", T.StringType())])).json(path)
    checked = row_sha(raw.withColumnRenamed("row_sha", "__given"), schema.names).withColumn("ok", F.col("row_sha") == F.col("__given"))
    return checked.where("ok").select(*schema.names), checked.where("NOT coalesce(ok, false)").select(*schema.names)


def manifest(df: DataFrame, group: str) -> DataFrame:
    """(group, rows, content_sum): what a pack holds; the sum of row hashes does not depend on order or files."""
    summed = F.sum(F.conv(F.substring("row_sha", 1, 12), 16, 10).cast("decimal(38,0)")).cast("string")
    return row_sha(df).groupBy(group).agg(F.count("*").alias("rows"), summed.alias("content_sum"))


# Shapes of secrets and personal data that must not leave in a pack.
SECRET_PATTERNS = {"key_assignment": r"(?i)(?:api[_-]?key|secret|token)\s*[=:]\s*\S{8,}", "bearer": r"(?i)bearer\s+[a-z0-9._\-]{16,}", "email": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----"}


def secret_hits(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind) for every text with something that looks like a secret or an address."""
    kinds = F.array_compact(F.array(*[F.when(F.col(text).rlike(p), F.lit(k)) for k, p in SECRET_PATTERNS.items()]))
    return df.select(key, F.explode(kinds).alias("kind"))
