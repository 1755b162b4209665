"""Log-shaped views over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import COLUMNS, DAY_NS, DEFAULT_SHARDS, derived, floor_div

SERVICES = ("accounts", "payments", "search", "indexer", "planner")
TENANTS = ("tenant-red", "tenant-blue", "tenant-green", "")


def _pick(index, values):
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def raw_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table ``events`` as log entries."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k")
    stamp = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts as timestamp_ntz))") * 1000
    return e.select(
        F.concat(F.lit("evt-"), F.lpad(F.col("event_id").cast("string"), 10, "0")).alias("id"),
        stamp.alias("timestamp_ns"),
        stamp.alias("received_at_ns"),
        _pick(F.col("user_id"), TENANTS).alias("namespace"),
        _pick(F.col("user_id"), SERVICES).alias("service"),
        F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "WARN").otherwise("INFO").alias("level"),
        F.concat("event_type", F.lit(" event from user-"), "user_id", F.lit(" [k="), k, F.lit("]")).alias("message"),
        F.create_map(F.lit("k"), k).alias("fields"),
    )


def logs(spark: SparkSession, sf_dir: str, shards: int = DEFAULT_SHARDS) -> DataFrame:
    """``raw_logs`` with tokens, shard_id, event_date and a segment a day."""
    return with_segment(derived(raw_logs(spark, sf_dir), shards))


def with_segment(df: DataFrame) -> DataFrame:
    return df.withColumn("segment", floor_div("timestamp_ns", DAY_NS))


def doc_logs(spark: SparkSession, sf_dir: str, shards: int = DEFAULT_SHARDS) -> DataFrame:
    """Table ``documents`` as log entries, one a minute, with its text as message."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stamp = F.lit(1704067200000000000) + F.col("doc_id") * 60_000_000_000
    own = d.select(
        F.concat(F.lit("doc-"), F.lpad(F.col("doc_id").cast("string"), 10, "0")).alias("id"),
        stamp.alias("timestamp_ns"),
        stamp.alias("received_at_ns"),
        F.col("lang").alias("namespace"),
        F.col("source").alias("service"),
        F.lit("INFO").alias("level"),
        F.col("text").alias("message"),
        F.create_map(F.lit("n_chars"), F.col("n_chars").cast("string")).alias("fields"),
    )
    return with_segment(derived(own.select(*COLUMNS), shards))
