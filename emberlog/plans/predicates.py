"""From the search language and its parameters to Spark predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import folded, shard_of
from .language import And, Field, Node, Term, lower_term

_TEXT_FIELDS = {"level", "service", "namespace", "message"}


def has_token(token: str) -> Column:
    return F.array_contains("tokens", token)


def field_equals(name: str, value: str) -> Column:
    """One ``field:value``. Field names of the record are known in any case; all others are looked up as typed
    in the open map, where a missing key equals the empty value."""
    known = name.lower() if name.lower() in _TEXT_FIELDS else None
    match known:
        case "level":
            return folded("level") == folded(F.lit(value))
        case "message":
            return has_token(lower_term(value))
        case None:
            return F.coalesce(F.col("fields")[F.lit(name)], F.lit("")) == value
        case column:
            return F.col(column) == value


def predicate(node: Node | None) -> Column:
    """The condition for a query tree; deep trees are built from the leaves up, without recursion."""
    if node is None:
        return F.lit(True)
    done: list[Column] = []
    todo: list[tuple[Node, bool]] = [(node, False)]
    while todo:
        x, built = todo.pop()
        if isinstance(x, Term):
            done.append(has_token(x.token))
        elif isinstance(x, Field):
            done.append(field_equals(x.name, x.value))
        elif not built:
            todo += [(x, True), (x.right, False), (x.left, False)]
        else:
            right, left = done.pop(), done.pop()
            done.append(left & right if isinstance(x, And) else left | right)
    return done[0]


def parameters(namespace: str = "", service: str = "", start_ns: int = 0, end_ns: int = 0, shards: int | None = None) -> Column:
    """Filters given beside the query; empty texts and bounds that aren't positive filter nothing.

    With ``shards`` (a table laid out by shard), tenant and service together also name the one shard to read.
    Time bounds carry the day along, so that day folders outside the range are never listed.
    """
    out = F.lit(True)
    if namespace:
        out &= F.col("namespace") == namespace
    if service:
        out &= F.col("service") == service
    if shards and namespace and service:
        out &= F.col("shard_id") == shard_of(F.lit(namespace), F.lit(service), shards)
    for bound, under in ((start_ns, False), (end_ns, True)):
        if bound > 0:
            out &= (F.col("timestamp_ns") <= bound) if under else (F.col("timestamp_ns") >= bound)
            if shards:
                day = F.date_add(F.lit("1970-01-01").cast("date"), F.lit(bound // 86_400_000_000_000))
                out &= (F.col("event_date") <= day) if under else (F.col("event_date") >= day)
    return out
