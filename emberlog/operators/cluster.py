"""Deterministic shard assignment and liveness, as functions of the node table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HEARTBEAT_TIMEOUT_S = 15


def live(nodes: DataFrame, now_ns: int, timeout_s: int = HEARTBEAT_TIMEOUT_S) -> DataFrame:
    """Add ``healthy``: seen no longer ago than the timeout."""
    return nodes.withColumn("healthy", F.lit(now_ns) - F.col("last_seen_ns") <= timeout_s * 1_000_000_000)


def assign(spark: SparkSession, nodes: DataFrame, shards: int) -> DataFrame:
    """(shard_id, primary, replica): shards go round the healthy nodes in order of name; the replica is the
    first healthy node that isn't the primary. Columns are null where no node is left."""
    ranked = nodes.where("healthy").withColumn("place", F.row_number().over(Window.orderBy("node_id")) - 1)
    facts = ranked.agg(F.count("*").alias("n"), F.min("node_id").alias("first"), F.min(F.when(F.col("place") == 1, F.col("node_id"))).alias("second"))
    turns = spark.range(shards).select(F.col("id").cast("int").alias("shard_id"), F.lit(1).alias("one")).join(F.broadcast(facts.withColumn("one", F.lit(1))), "one")  # facts is one row
    dealt = turns.withColumn("turn", F.col("shard_id") % F.when(F.col("n") > 0, F.col("n"))).join(ranked.select(F.col("place").alias("turn"), F.col("node_id").alias("primary")), "turn", "left")
    replica = F.when(F.col("primary") == F.col("first"), F.col("second")).otherwise(F.col("first"))
    return dealt.select("shard_id", "primary", F.when(F.col("primary").isNotNull(), replica).alias("replica"))


def status(assigned: DataFrame) -> DataFrame:
    """Shards by primary."""
    return assigned.where("primary is not null").groupBy("primary").agg(F.count("*").alias("shards"))
