"""Streaming ingest: files or any stream of entries into a LogStore, exactly once by id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..engine import LogStore
from ..operators.ingest import with_stable_ids
from ..schema import LOG_SCHEMA, floor_div


def nullable_schema() -> StructType:
    return StructType([type(f)(f.name, f.dataType, True) for f in LOG_SCHEMA])


def file_stream(spark: SparkSession, folder: str, kind: str = "json") -> DataFrame:
    return spark.readStream.schema(nullable_schema()).format(kind).load(folder)


def ingest_stream(entries: DataFrame, engine: LogStore, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append a stream's valid entries. Batches are deduplicated against the table, so a batch replayed after a
    failure adds nothing: entries without id get one from their batch and content. No watermark is used, so entries
    of any timestamp, zero included, are kept."""

    def store(batch: DataFrame, number: int) -> None:
        engine.ingest_batch(with_stable_ids(batch, f"{checkpoint}/{number}"))

    writer = entries.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def rates(logs: DataFrame, seconds: int = 300) -> DataFrame:
    """Entries by window and level, for dashboards; works on tables and streams alike."""
    stamp = F.timestamp_micros(floor_div("timestamp_ns", 1000))
    return logs.groupBy(F.window(stamp, f"{seconds} seconds").alias("w"), "level").agg(F.count("*").alias("entries"))
