"""The bounded labelled sample of a document classifier, and scoring of whole tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, in_arrow, staged, text_of


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """About ``rows`` labelled documents outside the held-out fold, drawn by hash: (fold, label, text), staged.

    Labels repeated for a document count once, the largest; null labels and ids count as none.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label")).where(fold() != 0)
    share = min(1.0, rows / max(1, known.count()))
    picked = known.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) < int(share * (1 << 20)))
    own = docs.select(F.col("doc_id").alias("doc_id"), text_of().alias("text"))
    # The picked ids are at most about ``rows`` by construction, so sending them out is bounded.
    return staged(own.join(F.broadcast(picked), "doc_id").select(fold().alias("fold"), "label", "text"), f"{label}-sample")


def sample_features(sample: DataFrame, width: int, extract: Callable[[list[str], list[int]], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fold, label, features) of the bounded sample, in a fixed order; ``extract`` gets texts and their folds."""

    def run(batches):
        for batch in batches:
            x = extract(batch.column("text").to_pylist(), batch.column("fold").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("fold"), batch.column("label"), pa.array(list(x), pa.list_(pa.float64()))], ["fold", "label", "x"])

    rows: pd.DataFrame = in_arrow(sample, run, f"fold {sample.schema['fold'].dataType.simpleString()}, label int, x array<double>").toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), width)
    order = np.lexsort(np.column_stack([x, rows["label"], rows["fold"]]).T) if len(rows) else np.arange(0)
    return rows["fold"].to_numpy(float)[order], rows["label"].to_numpy(int)[order], x[order]


def scored(docs: DataFrame, score: Callable[[list[str]], np.ndarray], limit: float) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    own = docs.select(F.col("doc_id").alias("doc_id"), text_of().alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score(part.column("text").to_pylist()), pa.float64())], ["doc_id", "score"])

    out = in_arrow(own, run, f"doc_id {kind}, score double")
    return out.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))
