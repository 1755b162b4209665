"""Text and hash functions as Columns, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that simple case folding holds equal though lower() keeps them apart.
FOLD_FROM = "ſςµϐϑϕϖϰϱϵẛι"
FOLD_TO = "sσμβθφπκρεṡι"

# 32-bit FNV-1a.
FNV_START, FNV_PRIME, MASK = 2166136261, 16777619, 0xFFFFFFFF


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lower(text: Column | str) -> Column:
    """Lower-case letter by letter: the dotted capital I gives a plain i."""
    return F.lower(F.translate(_col(text), "İ", "I"))


def tokenize(text: Column | str) -> Column:
    """Distinct tokens: lower-case, split at all but a-z and 0-9, empties dropped."""
    return F.array_distinct(F.filter(F.split(lower(text), "[^a-z0-9]+"), lambda t: t != ""))


def all_tokens(text: Column | str) -> Column:
    """Tokens in order, repeats included."""
    return F.filter(F.split(lower(text), "[^a-z0-9]+"), lambda t: t != "")


def folded(text: Column | str) -> Column:
    """A form equal for texts that differ by simple case folding only."""
    return F.translate(F.lower(_col(text)), FOLD_FROM, FOLD_TO)


def fnv1a32(text: Column | str) -> Column:
    """FNV-1a over the UTF-8 bytes of a text, as an unsigned 32-bit value in a long. An empty text gives the start value."""
    raw = F.hex(F.encode(_col(text), "UTF-8"))
    octets = F.when(F.length(raw) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.length(raw), F.lit(1)), F.lit(2)), lambda i: F.conv(F.substring(raw, i, F.lit(2)), 16, 10).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(octets, F.lit(FNV_START).cast("long"), lambda h, b: (h.bitwiseXOR(b) * FNV_PRIME).bitwiseAND(F.lit(MASK).cast("long")))


def shard_of(namespace: Column | str, service: Column | str, shards: int) -> Column:
    """Shard of an entry: hash of ``namespace:service`` modulo the number of shards; 0 without shards."""
    if shards <= 0:
        return F.lit(0)
    return (fnv1a32(F.concat(_col(namespace), F.lit(":"), _col(service))) % shards).cast("int")


def auto_id() -> Column:
    """A fresh random id, for entries that came without one."""
    return F.concat(F.lit("auto-"), F.substring(F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")), 1, 16))


def now_ns() -> Column:
    """The clock in nanoseconds (microsecond steps)."""
    return F.unix_micros(F.current_timestamp()) * 1000
