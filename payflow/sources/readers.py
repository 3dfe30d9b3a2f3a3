"""Readers: typed CSV tables, extended-JSON documents, CDC messages, FX payloads, XML, binary files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from payflow.sources.schemas import CDC_MESSAGE, LOAD_ORDER, OLTP


def read_oltp(spark: SparkSession, directory: str, table: str) -> DataFrame:
    """A1: one CSV table with header, its declared schema, fail fast on malformed rows."""
    return (spark.read.schema(OLTP[table]).option("header", True).option("mode", "FAILFAST")
            .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSS]XXX").csv(f"{directory.rstrip('/')}/{table}.csv"))


def read_all_oltp(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    """A1: every table, parents before children."""
    return {t: read_oltp(spark, directory, t) for t in LOAD_ORDER}


def read_star(spark: SparkSession, directory: str, table: str, schema: T.StructType | None = None) -> DataFrame:
    """A2: a star table from CSV (with a declared schema) or Parquet."""
    path = f"{directory.rstrip('/')}/{table}"
    if schema is not None:
        return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path + ".csv")
    return spark.read.parquet(path)


def date_of(c: Column) -> Column:
    """Extended-JSON date ``{"$date": "2024-01-01T00:00:00Z"}`` -> timestamp."""
    return F.to_timestamp(c.getField("$date"))


def read_documents(spark: SparkSession, path: str, schema: T.StructType, date_fields: list[str]) -> DataFrame:
    """A3: a JSON array of documents (multi-line) with dates as ``{"$date": iso}``; the
    listed top-level fields are converted to timestamps."""
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    for f in date_fields:
        df = df.withColumn(f, date_of(F.col(f)))
    return df


def read_cdc(spark: SparkSession, path: str) -> DataFrame:
    """A4: landed change messages (JSON lines: topic, key, value, ingested_at)."""
    return spark.read.schema(CDC_MESSAGE).json(path)


def with_load_time(df: DataFrame, name: str = "loaded_at") -> DataFrame:
    """Rows of a file source with the time at which their file was committed."""
    return df.select("*", F.col("_metadata.file_modification_time").alias(name))


def exclude_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """A5: personal columns never leave the source (dropped before any sink)."""
    return df.drop(*cols)


TOPIC_PREFIX = "pay"


def route_topic(df: DataFrame, col: str = "topic", prefix: str = TOPIC_PREFIX) -> DataFrame:
    """``<prefix>.public.<table>`` -> ``<prefix>.<table>``."""
    return df.withColumn(col, F.regexp_replace(col, rf"^{re.escape(prefix)}\.public\.(.*)$", f"{prefix}.$1"))


def parse_messages(msgs: DataFrame, envelope: T.StructType, key_field: str = "transaction_id",
                   options: dict[str, str] | None = None) -> DataFrame:
    """``msgs`` with the parsed envelope ``_env`` and ``_cause``, null for a usable message, else why it
    is dead: ``unparsable`` value, ``no_operation``, ``no_position`` or ``no_key``."""
    corrupt = "_corrupt_record"
    schema = T.StructType([*envelope.fields, T.StructField(corrupt, T.StringType())])
    env = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt, **(options or {})})
    # parse once per message: a filter on a plain projected column would be pushed below
    # the projection and inline (re-run) the parser; it cannot move below a generator
    parsed = msgs.select("*", F.explode(F.array(env)).alias("_env"))
    key = F.coalesce(F.col(f"_env.after.{key_field}"), F.col(f"_env.before.{key_field}"))
    return parsed.withColumn("_cause", F.when(F.col("value").isNull() | F.col("_env").isNull()
                                              | F.col(f"_env.{corrupt}").isNotNull(), "unparsable")
                             .when(F.col("_env.op").isNull(), "no_operation")
                             .when(F.col("_env.source.lsn").isNull(), "no_position")
                             .when(key.isNull(), "no_key"))


def dead_letters(parsed: DataFrame) -> DataFrame:
    """The dead messages of ``parse_messages`` as they came, with topic, key, raw value, time and cause."""
    return parsed.filter(F.col("_cause").isNotNull()).select("topic", "key", "value", "ingested_at",
                                                             F.col("_cause").alias("error"))


def split_dlq(msgs: DataFrame, envelope: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(parsed, dead letters); every message is in exactly one of them."""
    parsed = parse_messages(msgs, envelope)
    return parsed.filter(F.col("_cause").isNull()).drop("_cause"), dead_letters(parsed)


def load_fx(payloads: DataFrame, col: str = "payload") -> DataFrame:
    """FX API payloads ``{"base": "USD", "date": "YYYY-MM-DD", "rates": {"EUR": 0.92}}``
    -> (rate_date, currency_code, rate_to_usd). With base USD the quoted rate is
    currency-per-USD, so the rate to USD is its inverse."""
    schema = "base string, date string, rates map<string, double>"
    p = payloads.select(F.from_json(col, schema).alias("p"))
    e = p.select(F.to_date("p.date").alias("rate_date"), F.col("p.base").alias("base"),
                 F.explode("p.rates").alias("currency_code", "rate"))
    rate = F.when(F.col("base") == "USD", F.lit(1.0) / F.col("rate")).otherwise(F.col("rate"))
    return e.select("rate_date", "currency_code", rate.cast("decimal(18,8)").alias("rate_to_usd"),
                    F.lit("api").alias("source"))


def parse_xml_messages(df: DataFrame, col: str, schema: str | T.StructType) -> DataFrame:
    """Partner XML messages -> typed columns, the original text kept as ``raw_xml``."""
    return df.select(F.col(col).alias("raw_xml"), F.from_xml(F.col(col), schema).alias("msg")) \
        .select("raw_xml", "msg.*")


def read_xml_files(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """XML files with one record per ``row_tag`` element (built-in XML source)."""
    return spark.read.format("xml").option("rowTag", row_tag).load(path)


def evidence_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Dispute evidence files -> (path, kind, size, sha256, modified); content is hashed
    on the executors and never collected."""
    b = spark.read.format("binaryFile").load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = (F.when(ext == "pdf", "application/pdf").when(ext.isin("jpg", "jpeg"), "image/jpeg")
            .when(ext == "png", "image/png").otherwise("application/octet-stream"))
    return b.select("path", kind.alias("content_type"), F.col("length").alias("size_bytes"),
                    F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("uploaded_at"))
