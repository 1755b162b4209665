"""Inverted index, zone maps and Bloom filters over segments, and segment pruning with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import all_tokens, lower
from ..plans.language import And, Field, Node, Term, lower_term

BLOOM_LEAST, BLOOM_ERROR = 100, 0.01


def postings(logs: DataFrame) -> DataFrame:
    """Distinct (token, segment)."""
    return logs.select(F.explode("tokens").alias("token"), "segment").distinct()


def label_postings(logs: DataFrame) -> DataFrame:
    """Distinct (namespace, service, segment)."""
    return logs.select("namespace", "service", "segment").distinct()


def zone_map(logs: DataFrame) -> DataFrame:
    """Time range of each segment."""
    return logs.groupBy("segment").agg(F.min("timestamp_ns").alias("min_ns"), F.max("timestamp_ns").alias("max_ns"))


def resolve(tokens_index: DataFrame, labels: DataFrame, zones: DataFrame, tokens: list[str] = (), namespace: str = "", service: str = "", start_ns: int = 0, end_ns: int = 0) -> DataFrame:
    """Segments that may hold a match: all tokens, tenant, service and time range, each by the index alone."""
    out = zones
    if start_ns > 0:
        out = out.where(F.col("max_ns") >= start_ns)
    if end_ns > 0:
        out = out.where(F.col("min_ns") <= end_ns)
    out = out.select("segment")
    wanted = sorted(set(tokens))
    if wanted:
        held = tokens_index.where(F.col("token").isin(wanted)).groupBy("segment").agg(F.count("token").alias("n")).where(F.col("n") == len(wanted))
        out = out.join(held, "segment", "left_semi")
    # Tenant and service are looked up apart, as the index keeps them apart.
    for column, value in (("namespace", namespace), ("service", service)):
        if value:
            out = out.join(labels.where(F.col(column) == value), "segment", "left_semi")
    return out


def token_count(tokens_index: DataFrame) -> DataFrame:
    return tokens_index.agg(F.count_distinct("token").alias("tokens"))


def without_segments(index: DataFrame, removed: DataFrame) -> DataFrame:
    """The index after segments are gone; tokens held nowhere else go with them."""
    return index.join(removed.select("segment"), "segment", "left_anti")


def bloom_keys() -> Column:
    """What a segment's Bloom filter holds of an entry: message tokens and lower-cased labels and field values.

    Values of open fields are included, so that a field predicate can't prune a segment that has the field.
    """
    return F.concat(all_tokens("message"), F.transform(F.array("level", "service", "namespace"), lambda x: lower(x)), F.transform(F.map_values("fields"), lambda x: lower(x)))


class SegmentBlooms:
    """A Bloom filter per segment, built in the JVM; meant for few large segments."""

    def __init__(self, filters: dict):
        self.filters = filters

    @classmethod
    def build(cls, logs: DataFrame) -> "SegmentBlooms":
        keyed = logs.select("segment", F.explode(bloom_keys()).alias("key"))
        sizes = {r.segment: r.n for r in keyed.groupBy("segment").agg(F.count("*").alias("n")).collect()}
        filters = {s: keyed.where(F.col("segment") == s)._jdf.stat().bloomFilter("key", max(BLOOM_LEAST, n), BLOOM_ERROR) for s, n in sizes.items()}
        return cls(filters)

    def candidates(self, node: Node | None) -> list:
        """Segments that the filters can't rule out."""
        return sorted(s for s, f in self.filters.items() if not self._misses(f, node))

    def _misses(self, bloom, node: Node | None) -> bool:
        if isinstance(node, And):
            return self._misses(bloom, node.left) or self._misses(bloom, node.right)
        if isinstance(node, Term):
            return not bloom.mightContainString(node.token)
        if isinstance(node, Field) and node.value and node.value.isascii():  # a missing field equals ""; other letters fold in more ways
            return not bloom.mightContainString(lower_term(node.value))
        return False  # OR never rules out


def prune(logs: DataFrame, segments: DataFrame) -> DataFrame:
    """Only the entries of the given segments."""
    return logs.join(segments.select("segment"), "segment", "left_semi")


