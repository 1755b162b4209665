"""Connected components of a link table, distributed: smallest neighbour label with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(links: DataFrame) -> DataFrame:
    """(id, comp) for every id in ``links`` (a, b): comp is the smallest id reachable.

    Each round takes the smallest label among a node's neighbours, hands it to the node's old root too, then
    follows labels of labels. Aggregations are minima, so a node of any degree costs a row a task.
    """
    edges = staged(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "cc-edges")
    labels = staged(edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("comp")), "cc-labels")
    while True:
        seen = edges.join(labels.select(F.col("id").alias("b"), F.col("comp").alias("near")), "b").groupBy("a").agg(F.min("near").alias("near"))
        lower = labels.join(seen, F.col("id") == F.col("a")).select("id", "comp", F.least("comp", "near").alias("next"))
        # A root learns the smallest label that any of its followers saw.
        root = lower.groupBy("comp").agg(F.min("next").alias("low")).select(F.col("comp").alias("r"), "low")
        hooked = staged(lower.join(root, F.col("comp") == F.col("r")).select("id", "comp", F.least("next", "low").alias("next")), "cc-hooked")
        jump = hooked.select(F.col("id").alias("j"), F.col("next").alias("far"))
        new = staged(hooked.join(jump, F.col("next") == F.col("j"), "left").select("id", F.coalesce("far", "next").alias("comp"), (F.coalesce("far", "next") != F.col("comp")).alias("moved")), "cc-labels")
        moved = new.where("moved").limit(1).count()
        labels = new.drop("moved")
        if not moved:
            return labels
