"""Compaction and retention planning over a table of segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DAY_NS

MERGE_BELOW = 32 << 20
RETENTION_DAYS = 7


def merge_runs(segments: DataFrame, below: int = MERGE_BELOW) -> DataFrame:
    """(segment, run) for neighbouring closed segments under the size bound, runs of two or more.

    Takes (segment, bytes); a run bears the name of its first segment. A segment's place among all minus its
    place among the small ones is the same within a run, so the table is sorted once and never self-joined.
    """
    if below <= 0:
        return segments.select("segment", F.col("segment").alias("run")).limit(0)
    order = Window.orderBy("segment")  # one row per file: the plan is small next to the data it describes
    placed = segments.withColumn("small", F.col("bytes") < below).withColumn("place", F.row_number().over(order))
    small = placed.where("small").withColumn("island", F.col("place") - F.row_number().over(order))
    island = Window.partitionBy("island")
    return small.select("segment", F.min("segment").over(island).alias("run"), F.count("*").over(island).alias("n")).where("n > 1").drop("n")


def expired(zones: DataFrame, now_ns: int, days: int = RETENTION_DAYS) -> DataFrame:
    """Segments whose newest entry is positive and older than the retention; none if days is 0."""
    if days <= 0:
        return zones.limit(0)
    return zones.where((F.col("max_ns") > 0) & (F.col("max_ns") < now_ns - days * DAY_NS))
