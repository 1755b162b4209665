"""The log record and how any table of logs is brought to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.text import shard_of, tokenize

#: Columns of a log entry. Absent values are zero values, never null.
LOG_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("timestamp_ns", T.LongType(), False),
        T.StructField("received_at_ns", T.LongType(), False),
        T.StructField("namespace", T.StringType(), False),
        T.StructField("service", T.StringType(), False),
        T.StructField("level", T.StringType(), False),
        T.StructField("message", T.StringType(), False),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType()), False),
    ]
)
COLUMNS = LOG_SCHEMA.fieldNames()
DEFAULT_SHARDS = 16
DAY_NS = 86_400_000_000_000


def normalise(df: DataFrame) -> DataFrame:
    """The eight log columns in order, missing columns and nulls as zero values."""
    out = []
    for field in LOG_SCHEMA:
        kind = field.dataType.simpleString()
        own = F.col(field.name).cast(kind) if field.name in df.columns else F.lit(None).cast(kind)
        zero = F.lit("") if kind == "string" else F.lit(0).cast("long") if kind == "bigint" else F.map_from_arrays(*[F.array().cast("array<string>")] * 2)
        out.append(F.coalesce(own, zero).alias(field.name))
    return df.select(*out)


def derived(df: DataFrame, shards: int = DEFAULT_SHARDS) -> DataFrame:
    """Add what is stored beside an entry: its tokens, its shard and the day of its timestamp."""
    return df.withColumns(
        {
            "tokens": tokenize("message"),
            "shard_id": shard_of("namespace", "service", shards),
            "event_date": event_date("timestamp_ns"),
        }
    )


def event_date(column: str):
    return F.date_add(F.lit("1970-01-01").cast("date"), floor_div(column, DAY_NS).cast("int"))


def floor_div(column: str, by: int) -> Column:
    """The whole number at or under column / by, in integers throughout: doubles lose the last nanoseconds of a day."""
    return F.expr(f"`{column}` div {by}L - if(`{column}` % {by}L < 0, 1, 0)")
