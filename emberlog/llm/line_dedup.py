"""Line dedup over levelled sorted runs of line hashes.

Documents are taken in batches of ascending doc_id. The index is a set of immutable runs, each holding
(line key, first doc_id) in buckets of the key's hash, each bucket one file sorted by key. A batch first reduces
its own lines to the first document of each key, merge-anti-joins that against the runs, which are read in their
stored order without shuffle or sort, and writes what is new as a run of level 0; when a level holds
``fan_in`` runs they are merged, bucket by bucket, into one run of the next level. As batches ascend, the runs
hold the smallest doc_id of every key, so a document's line goes when its key's first doc_id is smaller.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE_BYTES, bucketed, in_arrow, partitions, staged, text_of

#: The id that stands for null: such rows count as one document after all others.
NO_ID = 2**63 - 1
MIN_POINTS = 10
#: Batches: this many at least, and more so that one has about so many (line, document) rows.
LEAST_BATCHES, BATCH_LINES = 4, 1 << 30


def line_key(line: bytes) -> bytes | None:
    """16-byte hash of a line's key, or None if the key has under ten code points."""
    key = line.strip(WHITE_BYTES).lower()
    if len(key) < MIN_POINTS or (not key.isascii() and len(key.decode()) < MIN_POINTS):
        return None
    return xxhash.xxh3_128_digest(key)


def _keys(batches):
    for batch in batches:
        ids, keys = [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            found = {k for line in text.as_buffer().to_pybytes().split(b"\n") if (k := line_key(line))}
            ids += [doc] * len(found)
            keys += found
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], ["key", "doc"])


class LineRuns:
    """The levelled index. ``add`` takes (key, first) rows that are unique by key and newer than every run."""

    def __init__(self, spark: SparkSession, fan_in: int = 4):
        self.fan_in, self.levels, self.buckets = fan_in, [], partitions(spark)

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, firsts: DataFrame) -> None:
        for run in self.runs():
            firsts = firsts.join(run.hint("merge"), "key", "left_anti")
        self._put(0, bucketed(firsts, "key", self.buckets, "line-run"))

    def _put(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fan_in:
            merged, *others = self.levels[level]
            for other in others:  # no key is in two runs
                both = merged.join(other.withColumnRenamed("first", "__other").hint("merge"), "key", "full_outer")
                merged = both.select("key", F.coalesce("first", "__other").alias("first"))
            self.levels[level] = []
            self._put(level + 1, bucketed(merged, "key", self.buckets, "line-run"))

    def table(self) -> DataFrame | None:
        out = None
        for run in self.runs():
            out = run if out is None else out.unionByName(run)
        return out


def _bounds(ids: DataFrame, batches: int) -> list[int]:
    """Ascending upper bounds that cut the ids into about equal batches; the last is open."""
    marks = ids.approxQuantile("doc", [i / batches for i in range(1, batches)], min(0.01, 0.2 / batches)) if batches > 1 else []
    return sorted({int(x) for x in marks})


def _apply(batches):
    for batch in batches:
        columns = {n: [] for n in ("kept_text", "n_lines", "n_dropped")}
        for text, gone in zip(batch.column("__text"), batch.column("__gone")):
            raw = text.as_buffer().to_pybytes()
            lines = raw.split(b"\n")
            gone = set(gone.as_py() or ())
            kept = [x for x in lines if line_key(x) not in gone] if gone else lines
            columns["kept_text"].append(b"\n".join(kept).decode())
            columns["n_lines"].append(len(lines))
            columns["n_dropped"].append(len(lines) - len(kept))
        rest = [c for c in batch.schema.names if c not in ("__text", "__gone")]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + [pa.array(columns["kept_text"], pa.string()), pa.array(columns["n_lines"], pa.int64()), pa.array(columns["n_dropped"], pa.int64())], [*rest, *columns])


def _deduped(docs: DataFrame, carry: list[str], batches: int | None, fan_in: int) -> DataFrame:
    """The columns named in ``carry`` as __c0, __c1 and so on, with kept_text, n_lines and n_dropped."""
    source = docs.select(F.coalesce(F.col("doc_id"), F.lit(NO_ID)).cast("long").alias("doc"), text_of().alias("text"))
    lines = staged(in_arrow(source, _keys, "key binary, doc long"), "line-keys")
    batches = batches or max(LEAST_BATCHES, lines.count() // BATCH_LINES)
    index, low = LineRuns(docs.sparkSession, fan_in), None
    for high in [*_bounds(lines, batches), None]:
        part = lines if low is None else lines.where(F.col("doc") > low)
        part = part if high is None else part.where(F.col("doc") <= high)
        index.add(part.groupBy("key").agg(F.min("doc").alias("first")))
        low = high
    gone = lines.join(index.table(), "key").where("doc > first").groupBy("doc").agg(F.collect_set("key").alias("__gone"))
    whole = docs.select(F.coalesce(F.col("doc_id"), F.lit(NO_ID)).cast("long").alias("doc"), *[F.col(c).alias(f"__c{i}") for i, c in enumerate(carry)], text_of().alias("__text"))
    joined = whole.join(gone, "doc", "left").drop("doc")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name not in ("__text", "__gone"))
    return in_arrow(joined, _apply, f"{kinds}, kept_text string, n_lines long, n_dropped long")


def line_dedup(docs: DataFrame, batches: int | None = None, fan_in: int = 2, carry: list[str] = ()) -> DataFrame:
    """Drop every line whose key (stripped, A-Z lower-cased, ten code points or more) an earlier document holds.

    Returns one row per input row: doc_id, the columns named in ``carry``, kept_text, n_lines, n_dropped.
    Null or empty text is one empty line. Rows that share a doc_id count as one document and keep their
    lines alike; rows without doc_id count as one document after all others. Lines repeated within the
    first document stay. An empty table gives no rows; other columns are ignored.
    """
    names = ["doc_id", *carry]
    return _deduped(docs, names, batches, fan_in).select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(names)], "kept_text", "n_lines", "n_dropped")


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, whatever their columns' names, with text, and n_chars if there is one, as ``line_dedup``
    leaves them."""
    new = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    out = _deduped(docs, docs.columns, None, 2)
    return out.select(*[new.get(c, F.col(f"__c{i}")).alias(c) for i, c in enumerate(docs.columns)])
