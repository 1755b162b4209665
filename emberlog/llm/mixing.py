"""Mixing sources to target weights by entropy balancing.

Rates r = exp(lambda_source * size / mean size of the source), cut at ``limit``, are the solution of
minimum relative entropy from one copy each under a token constraint per source. The multipliers solve the
convex dual by Newton steps, each a distributed aggregation over the (source, size) histogram and guarded by
a bracket. Rates are then rounded to whole copies by error diffusion inside small salted buckets of a source.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, text_of, word_count

#: A document is taken at most this many times.
LIMIT = 3


def _weighted(sources: DataFrame) -> DataFrame:
    """Add the weight (1, 2, 3, repeating) to (source, source_size) in code-point order, null last. The table has
    one row per source and is numbered by a distributed sort, not by a window over all rows."""
    spark = sources.sparkSession
    ordered = sources.orderBy(F.col("source").isNull(), "source").rdd.zipWithIndex()
    kinds = sources.select("source", "source_size").schema
    ranked = spark.createDataFrame(ordered.map(lambda x: (x[0].source, x[0].source_size, x[1] % 3 + 1)), f"source {kinds['source'].dataType.simpleString()}, source_size long, weight int")
    return staged(ranked, "mix-sources")


def source_targets(sized: DataFrame, limit: float = LIMIT) -> DataFrame:
    """(source, docs, source_size, weight, target) for rows (source, size); sources stay distributed."""
    sources = staged(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")), "mix-sums")
    ranked = _weighted(sources)
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    capped = F.lit(False)
    while True:
        # Capping only ever grows: each pass fixes the sources that the present level overfills.
        sums = ranked.agg(F.sum(F.when(~capped, F.col("weight"))).alias("w"), F.sum(F.when(capped, F.col("source_size"))).alias("s")).first()
        level = (total - limit * (sums.s or 0)) / sums.w if sums.w else 0.0
        more = capped | (level * F.col("weight") > limit * F.col("source_size"))
        if not ranked.where(more & ~capped).limit(1).count():
            break
        capped = more
    target = F.when(capped, F.lit(float(limit)) * F.col("source_size")).otherwise(F.lit(float(level)) * F.col("weight"))
    return ranked.withColumn("target", target.cast("double")).join(sources.select(F.col("source").alias("s"), "docs"), F.expr("source <=> s")).drop("s")


def solve_rates(sized: DataFrame, targets: DataFrame, limit: float = LIMIT, tolerance: float = 1e-6, steps: int = 200) -> DataFrame:
    """Newton on the dual: (source, tilt, mean) with sum(size * min(limit, exp(tilt * size / mean))) near target.

    A source that hasn't met its target after ``steps`` steps raises; the bracket grows without bound and is halved
    where Newton leaves it, so some dozen steps are usual.
    """
    state = staged(
        targets.where("source_size > 0").select("source", "source_size", "target", (F.col("source_size") / F.col("docs")).alias("mean"), F.lit(0.0).alias("tilt"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high")),
        "mix-state",
    )
    histogram = staged(sized.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")).select(F.col("source").alias("s"), "size", "n"), "mix-histogram")
    for _ in range(steps):
        x = F.col("size") / F.col("mean")
        rate = F.least(F.lit(float(limit)), F.exp(F.least(F.col("tilt") * x, F.lit(20.0))))
        mass = F.col("n") * F.col("size") * rate
        # Sums per source only: partial aggregation keeps a hot source to one row a task.
        sums = histogram.join(state, F.expr("s <=> source")).groupBy("s").agg(F.sum(mass).alias("got"), F.sum(F.when(rate < limit, mass * x).otherwise(0.0)).alias("slope"))
        gap = F.col("got") - F.col("target")
        low = F.when(gap < 0, F.greatest(F.coalesce("low", "tilt"), "tilt")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.least(F.coalesce("high", "tilt"), "tilt")).otherwise(F.col("high"))
        met = F.abs(gap) <= tolerance * F.greatest("target", F.lit(1.0))
        full = F.col("target") >= limit * F.col("source_size") * (1 - 1e-12)
        moved = state.join(sums, F.expr("source <=> s")).select("source", "source_size", "target", "mean", "tilt", low.alias("low"), high.alias("high"), (F.col("tilt") - gap / F.when(F.col("slope") > 0, F.col("slope"))).alias("newton"), met.alias("met"), full.alias("full"))
        inside = F.col("newton").isNotNull() & (F.col("low").isNull() | (F.col("newton") > F.col("low"))) & (F.col("high").isNull() | (F.col("newton") < F.col("high")))
        between = F.when(F.col("high").isNull(), F.greatest(F.lit(1.0), F.col("low") * 2 + 1)).when(F.col("low").isNull(), F.least(F.lit(-1.0), F.col("high") * 2 - 1)).otherwise((F.col("low") + F.col("high")) / 2)
        tilt = F.when(F.col("full"), 1e9).when(F.col("met"), F.col("tilt")).when(inside, F.col("newton")).otherwise(between)
        state = staged(moved.select("source", "source_size", "target", "mean", tilt.alias("tilt"), "low", "high", (F.col("met") | F.col("full")).alias("over")), "mix-state")
        if not state.where("not over").limit(1).count():
            return state.select("source", "tilt", "mean")
        state = state.drop("over")
    raise ArithmeticError(f"a source is not within {tolerance} of its target after {steps} steps")


def _diffuse(rows: pd.DataFrame) -> pd.DataFrame:
    """Round rates to copies from the longest document down; each carries the words still owed."""
    rows = rows.sort_values(["size", "doc_id", "h"], ascending=[False, True, True], kind="stable")
    owed, copies = 0.0, []
    for size, rate in zip(rows["size"], rows["rate"]):
        want = owed + rate * size
        n = min(LIMIT, max(0, math.floor(want / size + 0.5))) if size else 0
        owed = want - n * size
        copies.append(n)
    return rows.assign(copies=copies).drop(columns=["rate", "bucket", "h"])


def mix(docs: DataFrame, bucket_docs: int = 1000) -> DataFrame:
    """Decide how often each document is taken so that each source's words come near its target.

    Returns one row per input row: doc_id, source, size, source_size, target, rate, copies. Size is the
    number of words; null text has none and is taken no times. Null is a source of its own, the last. Repeated
    rows are weighed each for itself. Reruns agree, whatever the layout. An empty table gives no rows; other
    columns are ignored.
    """
    return _mix(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("source"), word_count(text_of()).alias("size"), F.xxhash64(text_of()).alias("h")), bucket_docs).drop("h")


def _mix(sized: DataFrame, bucket_docs: int) -> DataFrame:
    sized = staged(sized, "mix-sizes")
    targets = staged(source_targets(sized), "mix-targets")
    rates = solve_rates(sized, targets)
    plan = targets.join(rates.withColumnRenamed("source", "r"), F.expr("source <=> r"), "left").select(F.col("source").alias("s"), "source_size", "target", "docs", "tilt", "mean")
    rate = F.when(F.col("size") > 0, F.least(F.lit(float(LIMIT)), F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(20.0))))).otherwise(0.0)
    salt = F.pmod(F.xxhash64("doc_id", "h"), F.ceil(F.col("docs") / bucket_docs)).cast("long")
    rows = sized.join(plan, F.expr("source <=> s")).select("doc_id", "source", "size", "h", "source_size", "target", rate.alias("rate"), salt.alias("bucket"))
    kind = rows.schema["source"].dataType.simpleString()
    out = rows.withColumns({"tilted": F.col("rate"), "text_h": F.col("h")}).groupBy("source", "bucket").applyInPandas(_diffuse, f"doc_id long, source {kind}, size long, source_size long, target double, tilted double, text_h long, copies int")
    return out.withColumnsRenamed({"tilted": "rate", "text_h": "h"})


def mixed_documents(docs: DataFrame, bucket_docs: int = 1000) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with all its columns.

    Rows alike in doc_id, source and size share their copies out by rank, so repeated rows work too.
    """
    keys = ["doc_id", "source", "size", "h"]
    same = lambda by: F.row_number().over(Window.partitionBy(*[f"__{k}" for k in keys]).orderBy(by))
    sized = docs.withColumns({"__doc_id": F.col("doc_id").cast("long"), "__source": F.col("source"), "__size": word_count(text_of()), "__h": F.xxhash64(text_of())})
    taken = _mix(sized.select(*[F.col(f"__{k}").alias(k) for k in keys]), bucket_docs).where("copies > 0")
    taken = taken.select(*[F.col(k).alias(f"__{k}") for k in keys], "copies").withColumn("__rank", same(F.desc("copies")))
    taken = taken.select(*[F.col(f"__{k}").alias(f"__t_{k}") for k in (*keys, "rank")], "copies")
    ranked = sized.withColumn("__rank", same(F.lit(1)))
    both = ranked.join(taken.withColumnRenamed("copies", "__copies"), F.expr(" and ".join(f"__{k} <=> __t_{k}" for k in (*keys, "rank"))))
    return both.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)
