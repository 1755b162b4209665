"""Search: filter, optional dedup, exact total and one page, in one Spark job."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Observation, Row, Window
from pyspark.sql import functions as F

from ..plans.language import parse
from ..plans.predicates import parameters, predicate

DEFAULT_LIMIT = 100
LARGEST = 2**31 - 1


class InvalidQuery(ValueError):
    """A parameter of the query is out of range."""


@dataclass(frozen=True)
class LogQuery:
    query: str = ""
    namespace: str = ""
    service: str = ""
    start_ns: int = 0
    end_ns: int = 0
    limit: int = 0
    offset: int = 0

    def checked(self) -> "LogQuery":
        """The query with its default page size; negative or overlarge pages raise."""
        if self.limit < 0 or self.offset < 0:
            raise InvalidQuery("limit and offset must not be negative")
        if self.limit + self.offset > LARGEST:
            raise InvalidQuery("limit plus offset is too large")
        return replace(self, limit=self.limit or DEFAULT_LIMIT)


@dataclass
class QueryResult:
    entries: list[Row]
    total: int
    took_ms: int
    partial: bool = False
    failed: list[str] = field(default_factory=list)


def matching(logs: DataFrame, q: LogQuery, shards: int | None = None) -> DataFrame:
    """Entries that the query selects. ``shards`` tells that the table is laid out by day and shard."""
    return logs.where(parameters(q.namespace, q.service, q.start_ns, q.end_ns, shards) & predicate(parse(q.query)))


def first_by_id(logs: DataFrame, *order: str) -> DataFrame:
    """One entry per id: the first in the given order."""
    ranked = logs.withColumn("__rank", F.row_number().over(Window.partitionBy("id").orderBy(*order)))
    return ranked.where("__rank = 1").drop("__rank")


def newest_first(logs: DataFrame) -> DataFrame:
    return logs.orderBy(F.desc("timestamp_ns"), F.asc("id"))


def page(logs: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Newest first; each task keeps limit + offset rows only."""
    return newest_first(logs).offset(offset).limit(limit)


def run(found: DataFrame, q: LogQuery, columns: list[str]) -> QueryResult:
    """Collect one page and the exact total of ``found`` in the same job."""
    began, seen = time.monotonic(), Observation()
    counted = found.select(*columns).observe(seen, F.count(F.lit(1)).alias("total"))
    entries = page(counted, q.limit, q.offset).collect()
    return QueryResult(entries, seen.get["total"], int((time.monotonic() - began) * 1000))


def cancellable(df: DataFrame, group: str, job: Callable[[], QueryResult]) -> QueryResult:
    """Run ``job`` in a job group, so that ``sparkContext.cancelJobGroup(group)`` ends it."""
    context = df.sparkSession.sparkContext
    context.setJobGroup(group, group, interruptOnCancel=True)
    try:
        return job()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
