"""Exact dedup by deterministic block naming, in DataFrame functions only.

The normalised text is cut into fixed-size byte blocks. Distinct blocks are sorted, in the order of their 64-bit
keys, and numbered: equal blocks get one integer name. Adjacent names are then paired, the distinct pairs sorted and numbered in
turn, until one name is left per document. Names are handed back through a 64-bit block key; that key is
proved collision-free over the distinct blocks first (else another seed is drawn), so identities are
exact, while text is shuffled only once and after map-side de-duplication.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let, staged, text_of


def _blocks(size: int, each):
    """Column of ``each(block)`` over the fixed-size byte blocks of column ``norm`` (empty text: one empty block)."""
    last = F.floor((F.greatest(F.octet_length("norm"), F.lit(1)) - 1) / size).cast("int")
    return let(F.col("norm").cast("binary"), lambda raw: F.transform(F.sequence(F.lit(0), last), lambda i: each(F.substring(raw, i * size + 1, F.lit(size)))))


def _numbered(keys: DataFrame, by: list[str], label: str) -> DataFrame:
    """Sort distinct keys and number them in that order; staged, so a retry can't renumber."""
    return staged(keys.orderBy(*by).withColumn("name", F.monotonically_increasing_id()), label)


def name_documents(docs: DataFrame, block_bytes: int = 4096) -> DataFrame:
    """One row per input row: row, doc_id, sha (binary), level, name; equal (level, name) means equal text."""
    norm = docs.select(F.col("doc_id").alias("doc_id"), ascii_lower(text_of()).alias("norm"))
    seed = 0
    while True:
        key = lambda block, s=seed: F.xxhash64(F.lit(s), block)
        pieces = norm.select(F.explode(_blocks(block_bytes, lambda b: F.struct(key(b).alias("k"), b.alias("b")))).alias("p"))
        distinct = pieces.select("p.k", "p.b").distinct()
        names = _numbered(distinct.groupBy("k").agg(F.count("*").alias("n")), ["k"], "block-names")
        if names.where("n > 1").limit(1).count() == 0:
            break
        seed += 1
    rows = staged(
        norm.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha"), _blocks(block_bytes, key).alias("keys")),
        "block-keys",
    )
    gather = lambda df, name: df.groupBy("row").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", name))), lambda x: x[name]).alias("names"))
    single = F.size("keys") == 1
    lookup = names.select("k", "name")
    done = rows.where(single).select("row", F.element_at("keys", 1).alias("k")).join(lookup, "k").select("row", F.lit(0).alias("level"), "name")
    more = rows.where(~single).select("row", F.posexplode("keys").alias("pos", "k")).join(lookup, "k")
    current = staged(gather(more, "name"), "names")
    finished, level = [done], 0
    while current.limit(1).count():
        level += 1
        half = F.floor((F.size("names") + 1) / 2).cast("int")
        pair = lambda i: F.struct(F.get("names", 2 * i).alias("a"), F.coalesce(F.get("names", 2 * i + 1), F.lit(-1)).alias("b"))
        pairs = current.select("row", F.posexplode(F.transform(F.sequence(F.lit(0), half - 1), pair)).alias("pos", "p")).select("row", "pos", "p.a", "p.b")
        named = _numbered(pairs.select("a", "b").distinct(), ["a", "b"], "pair-names")
        current = staged(gather(pairs.join(named, ["a", "b"]), "name"), "names")
        finished.append(current.where(F.size("names") == 1).select("row", F.lit(level).alias("level"), F.element_at("names", 1).alias("name")))
        current = current.where(F.size("names") > 1)
    identity = finished[0]
    for x in finished[1:]:
        identity = identity.unionByName(x)
    return rows.select("row", "doc_id", "sha").join(identity, "row")


def exact_dedup(docs: DataFrame, block_bytes: int = 4096) -> DataFrame:
    """Group rows whose texts are identical after lower-casing A-Z.

    Returns one row per input row: doc_id, keep_id, group_size, kept, text_sha256. Null text counts as
    empty. The largest doc_id stays; a null doc_id is smaller than any id; of repeated rows with one
    doc_id and one text exactly one is kept. An empty table gives no rows; other columns are ignored.
    """
    named = name_documents(docs, block_bytes)
    named = staged(named, "block-identities")
    # Written down, so that the join below has a shuffle of its own, whose hot groups Spark can split.
    groups = staged(named.groupBy("level", "name").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("group_size")), "block-groups")
    return named.join(groups, ["level", "name"]).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
