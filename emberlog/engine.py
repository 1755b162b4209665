"""LogStore: one stored log table with ingest, search, index, compaction and retention."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DateType, IntegerType, StringType, StructType

from .operators import index, ingest, maintenance
from .operators.cache import PageCache
from .operators.search import LogQuery, QueryResult, first_by_id, matching, run
from .schema import COLUMNS, DAY_NS, DEFAULT_SHARDS, LOG_SCHEMA


class LogStore:
    """Entries lie as Parquet under ``path`` by event_date and shard_id, so that time ranges and tenant-and-
    service searches list only their folders. Ids are unique in the table: ingest drops those it holds."""

    def __init__(self, spark: SparkSession, path: str, shards: int = DEFAULT_SHARDS, cache: PageCache | None = None, max_rows_a_file: int = 5_000_000):
        self.spark, self.path, self.shards, self.max_rows = spark, path.rstrip("/"), shards, max_rows_a_file
        self.cache, self.version = cache if cache is not None else PageCache(), 0

    # Storage

    def _exists(self) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def table(self) -> DataFrame:
        schema = StructType(list(LOG_SCHEMA.fields)).add("tokens", ArrayType(StringType())).add("event_date", DateType()).add("shard_id", IntegerType())
        if not self._exists():
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("ignoreMissingFiles", "true").parquet(self.path)

    def segments(self) -> DataFrame:
        """The table with the file each entry lies in as ``segment``."""
        return self.table().withColumn("segment", F.input_file_name())

    def append(self, entries: DataFrame) -> None:
        entries.repartition("event_date", "shard_id").write.mode("append").option("maxRecordsPerFile", self.max_rows).partitionBy("event_date", "shard_id").parquet(self.path)
        self.version += 1

    # Ingest

    def ingest_batch(self, rows: DataFrame) -> dict[str, int]:
        """Store the valid rows with new ids; returns accepted and rejected, as given before dedup."""
        counted = ingest.counts(rows).first()
        self.append(ingest.unseen(ingest.prepared(rows, self.shards), self.table()))
        return {"accepted": counted.accepted, "rejected": counted.rejected}

    def ingest(self, **entry) -> str:
        """Store one entry and return its id; an invalid one raises."""
        if not entry.get("service") or not entry.get("message"):
            raise ValueError("service and message are required")
        own = {f.name: entry.get(f.name) for f in LOG_SCHEMA}
        own["id"] = own["id"] or f"auto-{uuid.uuid4().hex[:16]}"
        nullable = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in LOG_SCHEMA)
        self.ingest_batch(self.spark.createDataFrame([Row(**own)], nullable))
        return own["id"]

    def catch_up(self, primary: DataFrame) -> None:
        self.append(ingest.catch_up(primary, self.table()))

    # Search

    def find(self, query: LogQuery, dedup: bool = False) -> DataFrame:
        logs = self.table()
        if dedup:
            logs = first_by_id(logs, "received_at_ns", "timestamp_ns", "message")
        return matching(logs, query.checked(), self.shards)

    def search(self, query: LogQuery, dedup: bool = False) -> QueryResult:
        q = query.checked()
        key = (self.path, self.version, dedup, q)
        if (known := self.cache.get(key)) is not None:
            return known
        result = run(self.find(q, dedup), q, COLUMNS)
        self.cache.put(key, result)
        return result

    # Index and maintenance

    def postings(self) -> DataFrame:
        return index.postings(self.segments())

    def zone_map(self) -> DataFrame:
        return index.zone_map(self.segments())

    def retain(self, now_ns: int, days: int = maintenance.RETENTION_DAYS) -> int:
        """Drop day folders all of whose positive timestamps are past retention; returns how many went.

        A day is dropped whole, and days of timestamps that aren't positive stay.
        """
        if days <= 0 or not self._exists():
            return 0
        cutoff = now_ns - days * DAY_NS
        # A day after the cutoff's can't be past retention, so its folders aren't read.
        last = F.date_add(F.lit("1970-01-01").cast("date"), F.lit(cutoff // DAY_NS))
        spans = self.table().where(F.col("event_date") <= last).groupBy("event_date").agg(F.max("timestamp_ns").alias("max_ns")).where((F.col("max_ns") > 0) & (F.col("max_ns") < cutoff))
        gone = [r.event_date for r in spans.collect()]  # one row a day
        for day in gone:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/event_date={day}")
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        self.version += bool(gone)
        return len(gone)

    def compact(self, target: str) -> "LogStore":
        """Rewrite into ``target`` with one file a day and shard (split at the row bound); swap by using the result."""
        self.table().repartition("event_date", "shard_id").sortWithinPartitions("event_date", "shard_id", "timestamp_ns", "id").write.mode("overwrite").option("maxRecordsPerFile", self.max_rows).partitionBy("event_date", "shard_id").parquet(target)
        return LogStore(self.spark, target, self.shards, self.cache, self.max_rows)

