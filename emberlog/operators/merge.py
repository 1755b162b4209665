"""Federated search over several sources: gather, dedup by id, sort, page, and what to do when one fails."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from ..plans.language import parse
from .search import LogQuery, QueryResult, first_by_id, matching, run



def merged(parts: list[DataFrame], order: list[str] = ("timestamp_ns", "received_at_ns", "message")) -> DataFrame:
    """One entry per id over all parts, whichever part holds it."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return first_by_id(out, *order)


def federated(sources: Mapping[str, Callable[[], DataFrame]], query: LogQuery, columns: list[str], allow_partial: bool = False) -> QueryResult:
    """Search all sources as one. A source that can't be read fails the search, or with ``allow_partial`` is
    left out and named in the result; a query with a syntax error always raises."""
    q, began = query.checked(), time.monotonic()
    parse(q.query)
    parts, failed = [], []
    for name, open_ in sorted(sources.items()):
        try:
            part = open_()
            if allow_partial:
                part.limit(1).count()
            parts.append(part)
        except (PySparkException, OSError):
            if not allow_partial:
                raise
            failed.append(name)
    if not parts and failed:
        return QueryResult([], 0, int((time.monotonic() - began) * 1000), True, failed)
    if not parts:
        return QueryResult([], 0, 0)
    found = merged([matching(p, q) for p in parts])
    result = run(found, q, columns)
    result.partial, result.failed = bool(failed), failed
    return result
