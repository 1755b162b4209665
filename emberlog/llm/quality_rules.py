"""Quality rules per document and per host, in DataFrame functions only.

Each text is counted once and the counts are written down; rule failures are summed by host, the failure rates are shrunk with a beta prior
fitted to all hosts by moments, and hosts whose shrunk rate is too high lose their documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, let, staged, text_of

#: Rules by name: SQL conditions over the counts that mean failure.
RULES = {
    "few_words": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
}
BASE = ("few_words", "repeats")
SYMBOLS = "#*$%&|<>"


def _repeated(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more. Texts whose windows' hashes all differ have none; in
    others windows are sorted, by hash first, and compared word by word."""
    three = lambda i: (F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(*three(i)))

    def window(h: Column, i: Column) -> Column:
        a, b, c = three(i)
        return F.struct(h.alias("h"), a.alias("a"), b.alias("b"), c.alias("c"), i.alias("i"))

    def same(x: Column, y: Column) -> Column:
        return (x.h == y.h) & (x.a == y.a) & (x.b == y.b) & (x.c == y.c)

    def covered(hashes: Column) -> Column:
        runs = F.sort_array(F.transform(hashes, window))
        twice = let(runs, lambda s: F.filter(s, lambda e, k: F.coalesce(same(e, F.get(s, k + 1)), F.lit(False)) | ((k > 0) & same(e, F.get(s, F.greatest(k - 1, F.lit(0)))))))
        places = F.sort_array(F.transform(twice, lambda e: e.i))
        return let(places, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x))

    counted = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(words) >= 4, counted).otherwise(F.lit(0).cast("long"))


def document_counts(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = docs.select(F.col("doc_id").alias("doc_id"), F.col("source").alias("host"), text_of().alias("t"))
    words = let(F.split("t", WHITE), lambda a: F.filter(a, lambda w: w != ""))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.char_length(x)).alias("word_chars"), _repeated(w).alias("n_repeat_words")))
    by_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    symbols = (F.char_length("t") - F.char_length(F.translate("t", SYMBOLS, ""))).cast("long")
    return text.select("doc_id", "host", by_words.alias("w"), by_lines.alias("l"), symbols.alias("n_symbols")).select("doc_id", "host", "w.n_words", "w.word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "w.n_repeat_words")


def host_verdicts(judged: DataFrame, limit: float = 0.5) -> DataFrame:
    """(host, host_docs, shrunk_<rule>, host_kept) from rows with host and a boolean fail_<rule> for each rule.

    The prior of a rule has the mean m and variance v of the hosts' rates: strength m(1-m)/v - 1, held within
    1 and 10,000 (hosts all alike: 10,000).
    """
    hosts = judged.groupBy("host").agg(F.count("*").alias("host_docs"), *[F.count_if(F.col(f"fail_{r}")).alias(r) for r in RULES])
    rates = {r: F.col(r) / F.col("host_docs") for r in RULES}
    prior = hosts.agg(*[x for r in RULES for x in (F.avg(rates[r]).alias(f"mean_{r}"), F.var_pop(rates[r]).alias(f"var_{r}"))])
    both = hosts.withColumn("one", F.lit(1)).join(F.broadcast(prior.withColumn("one", F.lit(1))), "one")  # the prior is one row
    shrunk = {}
    for r in RULES:
        m, v = F.col(f"mean_{r}"), F.col(f"var_{r}")
        strength = F.when(v > 0, F.greatest(F.lit(1.0), F.least(F.lit(10000.0), m * (1 - m) / v - 1))).otherwise(F.lit(10000.0))
        shrunk[r] = ((F.col(r) + m * strength) / (F.col("host_docs") + strength)).alias(f"shrunk_{r}")
    scored = both.select("host", "host_docs", *shrunk.values())
    return scored.withColumn("host_kept", F.greatest(*[F.col(f"shrunk_{r}") for r in RULES]) <= limit)


def quality_rules(docs: DataFrame, limit: float = 0.5) -> DataFrame:
    """Judge every document by its own counts and by its host (column ``source``).

    Returns one row per input row: doc_id, host, the counts, base_failed, host_kept, kept. Null or empty text
    has no words and fails the base rules. Null is a host of its own. Repeated rows are judged each for
    itself. An empty table gives no rows; other columns are ignored.
    """
    counts = staged(document_counts(docs), "quality-counts")
    judged = counts.withColumns({f"fail_{r}": F.expr(c) for r, c in RULES.items()})
    hosts = host_verdicts(judged, limit).select(F.col("host").alias("h"), "host_kept")
    base = F.expr(" or ".join(f"fail_{r}" for r in BASE))
    return judged.join(hosts, F.expr("host <=> h")).select(*counts.columns, base.alias("base_failed"), "host_kept", (~base & F.col("host_kept")).alias("kept"))
