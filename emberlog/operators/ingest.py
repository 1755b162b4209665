"""Ingest: validation, stamping, routing, dedup against what is stored, and catch-up between copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import auto_id, now_ns
from ..schema import COLUMNS, DEFAULT_SHARDS, derived, normalise
from .search import first_by_id


def is_valid() -> Column:
    """A service and a message are needed; nothing else is asked."""
    return (F.coalesce("service", F.lit("")) != "") & (F.coalesce("message", F.lit("")) != "")


def split_valid(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where(is_valid()), rows.where(~is_valid())


def counts(rows: DataFrame) -> DataFrame:
    """One row: accepted, rejected."""
    return rows.agg(F.count_if(is_valid()).alias("accepted"), F.count_if(~is_valid()).alias("rejected"))


def prepared(rows: DataFrame, shards: int = DEFAULT_SHARDS, received_ns: Column | None = None) -> DataFrame:
    """Valid rows as they are stored: normalised, stamped, with an id, tokens, shard and day."""
    own = normalise(split_valid(rows)[0])
    own = own.withColumns({"received_at_ns": received_ns if received_ns is not None else now_ns(), "id": F.when(F.col("id") == "", auto_id()).otherwise(F.col("id"))})
    return derived(own, shards)


def with_stable_ids(rows: DataFrame, batch: str) -> DataFrame:
    """``rows`` normalised, those without id given one by the batch's name, their content and their rank among equal
    rows, so that a batch that comes again brings the same ids."""
    own = normalise(rows).withColumn("__content", F.sha2(F.concat_ws("\x01", F.lit(batch), F.to_json(F.struct(*COLUMNS))), 256))
    ranked = own.withColumn("__rank", F.row_number().over(Window.partitionBy("__content").orderBy("timestamp_ns")))
    made = F.concat(F.lit("auto-"), F.substring(F.sha2(F.concat_ws("/", "__content", "__rank"), 256), 1, 16))
    return ranked.withColumn("id", F.when(F.col("id") == "", made).otherwise(F.col("id"))).select(*COLUMNS)


def unseen(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """The batch's first entry of each id that isn't stored. Only the stored ids are read."""
    return first_by_id(batch, "received_at_ns", "timestamp_ns", "message").join(stored.select("id"), "id", "left_anti")


def high_water(logs: DataFrame) -> DataFrame:
    """Newest received_at_ns by shard."""
    return logs.groupBy("shard_id").agg(F.max("received_at_ns").alias("high_water_ns"))


def fetch_since(logs: DataFrame, shard: int, since_ns: int) -> DataFrame:
    """A shard's entries received at or after a time, oldest first."""
    return logs.where((F.col("shard_id") == shard) & (F.col("received_at_ns") >= since_ns)).orderBy("received_at_ns", "id")


def catch_up(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """What a replica lacks: entries at or after its high water by shard that it doesn't hold.

    The bound is inclusive and ids settle the entries that share its time; shards the replica has nothing of
    are copied whole.
    """
    mark = high_water(replica).select(F.col("shard_id").alias("s"), "high_water_ns")
    due = primary.join(mark, F.col("shard_id") == F.col("s"), "left").where(F.col("received_at_ns") >= F.coalesce("high_water_ns", F.lit(0))).drop("s", "high_water_ns")
    return due.join(replica.select("id"), "id", "left_anti")


def wrong_shard(rows: DataFrame, shards: int = DEFAULT_SHARDS) -> DataFrame:
    """Rows whose stored shard isn't the one that their tenant and service hash to."""
    return derived(rows.withColumnRenamed("shard_id", "stored_shard"), shards).where("stored_shard <> shard_id")
