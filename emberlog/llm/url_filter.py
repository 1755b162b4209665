"""URL filtering by association rules.

Given rules (host and path prefixes) decide first. For all other urls, combinations of url tokens that go with a
label are mined level by level, by distributed counts; rules are pruned by support, confidence and by simpler
rules that say as much while they are mined, none is cut off, and matched through an inverted index from tokens to rules.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, staged

# Rules given by the contract of the query.
GIVEN = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
VERDICTS = ("allow", "block")
#: Token sets up to this many bytes are sent to all executors; more are joined by shuffle.
SEND_BYTES = 16 << 20

_LOWER = {c: c + 32 for c in range(65, 91)}
_PARTS = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    found = _PARTS.search(url) if url else None
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


def given_rule(host: str, path: str, rules: dict[str, str]) -> str | None:
    """The longest rule whose host is ``host`` or a parent domain and whose path starts ``path``."""
    best, labels = None, host.split(".")
    for i in range(len(labels)):
        domain = ".".join(labels[i:])
        for cut in range(len(path) + 1):
            rule = domain + path[:cut]
            if rule in rules and (best is None or len(rule) > len(best)) and rule.startswith(domain + "/"):
                best = rule
            if cut > _longest(rules):
                break
    return best


def _longest(rules: dict[str, str]) -> int:
    return max(map(len, rules), default=0)


def tokens(url: str | None) -> list[str]:
    """Distinct tokens: domains, leading host word, path segments and suffix (digits as 0), query keys, fragment."""
    host, path = parts(url)
    if not host and not path:
        return []
    query = url.split("#", 1)[0].partition("?")[2]
    labels = host.split(".")
    segments = [re.sub(r"\d+", "0", s) for s in path.split("/") if s]
    found = {"scheme=" + url.split("://", 1)[0].lower(), "first=" + labels[0], "depth=" + str(min(len(segments), 5)), "end=/" if path.endswith("/") else "end="}
    found |= {"domain=" + ".".join(labels[i:]) for i in range(len(labels))}
    found |= {f"path{i}=" + s for i, s in enumerate(segments[:3])}
    found |= {"key=" + k.split("=", 1)[0] for k in query.split("&") if k} | ({"fragment"} if "#" in url else set())
    return sorted(found)


def _transactions(batches):
    for batch in batches:
        items = [tokens(u) for u in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.list_(pa.string())), batch.column(1)], ["items", "verdict"])


def _numbered(shared):
    """Baskets of token numbers, ascending; tokens without a number go."""

    def run(batches):
        number = shared.value
        for batch in batches:
            items = [sorted(number[t] for t in row if t in number) for row in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.list_(pa.int32())), batch.column(1)], ["items", "verdict"])

    return run


#: A token set (numbers, ascending) found in a basket, and what its parts say: the fewest urls of one, and the
#: highest confidence of one by verdict.
FOUND = "b long, allow long, block long, s array<int>, below long, best_allow double, best_block double"
_FOUND = pa.schema([("b", pa.int64()), ("allow", pa.int64()), ("block", pa.int64()), ("s", pa.list_(pa.int32())), ("below", pa.int64()), ("best_allow", pa.float64()), ("best_block", pa.float64())])


def _longer(batches):
    """The sets of one token more in each basket, all of whose parts of one token less are in its list."""

    def flush(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _FOUND.types)], schema=_FOUND)

    rows = []
    for batch in batches:
        for b, allow, block, sets in zip(*(batch.column(c).to_pylist() for c in ("b", "allow", "block", "sets"))):
            known = {tuple(x["s"]): (x["n"], x["best_allow"], x["best_block"]) for x in sets}
            ends = defaultdict(list)
            for s in sorted(known):
                ends[s[:-1]].append(s[-1])
            for head, last in ends.items():
                for i, x in enumerate(last):
                    for y in last[i + 1 :]:
                        own = (*head, x, y)
                        subsets = [known.get(own[:k] + own[k + 1 :]) for k in range(len(own))]
                        if None not in subsets:
                            n, best_allow, best_block = zip(*subsets)
                            rows.append((b, allow, block, own, min(n), max(best_allow), max(best_block)))
                if len(rows) >= 20_000:
                    yield flush(rows)
                    rows = []
    if rows:
        yield flush(rows)


def mine(labelled: DataFrame, support: float = 0.002, confidence: float = 0.6, least: int = 20) -> list[tuple[frozenset, str, float, float]]:
    """(tokens, verdict, confidence, support) from rows (url, verdict), by one token more a level.

    Support is at least ``least`` labelled urls. A rule is dropped if a part of its tokens gives the same verdict
    with no less confidence. A set that is in as many urls as a part of it says nothing that the part doesn't, and a
    verdict that a part is sure of can't gain: only the other sets, which the support alone bounds, grow longer.
    """
    spark = labelled.sparkSession
    raw = staged(in_arrow(labelled.select("url", "verdict"), _transactions, "items array<string>, verdict string"), "url-baskets")
    total = raw.count()
    if total < least:
        return []
    enough = max(least, math.ceil(support * total))
    # Only tokens that reach the support alone can be in a rule.
    common = raw.select(F.explode("items").alias("item"), "verdict").groupBy("item").agg(*(F.count(F.when(F.col("verdict") == v, 1)).alias(v) for v in VERDICTS))
    names = sorted(r.item for r in common.where(F.greatest(*VERDICTS) >= enough).select("item").collect())  # at most items per basket / support
    numbered = in_arrow(raw, _numbered(spark.sparkContext.broadcast({t: i for i, t in enumerate(names)})), "items array<int>, verdict string").where(F.size("items") > 0)
    # Equal baskets are one row with counts.
    equal = numbered.groupBy("items").agg(*(F.count(F.when(F.col("verdict") == v, 1)).alias(v) for v in VERDICTS))
    baskets = staged(equal.withColumn("b", F.monotonically_increasing_id()), "url-baskets-equal")
    none = F.lit(0.0)
    found = baskets.select("b", *VERDICTS, F.explode("items").alias("i")).select("b", *VERDICTS, F.array("i").alias("s"), F.lit(total + 1).cast("long").alias("below"), none.alias("best_allow"), none.alias("best_block"))
    rules: list[tuple[frozenset, str, float, float]] = []
    while True:
        n = F.col("allow") + F.col("block")
        counted = found.groupBy("s").agg(*(F.sum(v).alias(v) for v in VERDICTS), F.first("below").alias("below"), *(F.first(f"best_{v}").alias(f"best_{v}") for v in VERDICTS))
        sets = staged(counted.where((F.greatest(*VERDICTS) >= enough) & (n < F.col("below"))).withColumn("n", n), "url-sets")
        for v in VERDICTS:
            sure = F.col(v) / F.col("n")
            for r in sets.where((F.col(v) >= enough) & (sure >= confidence) & (sure > F.col(f"best_{v}"))).select("s", sure.alias("sure"), F.col(v).alias("count")).collect():
                rules.append((frozenset(names[i] for i in r.s), v, r.sure, r["count"] / total))
        best = {v: F.greatest(f"best_{v}", F.col(v) / F.col("n")) for v in VERDICTS}
        open_ = F.lit(False)
        for v in VERDICTS:
            open_ |= (F.col(v) >= enough) & (best[v] < 1)
        alive = sets.where(open_).select("s", "n", *(best[v].alias(f"best_{v}") for v in VERDICTS))
        if not (left := alive.count()):
            return rules
        if left * 100 <= SEND_BYTES:
            alive = F.broadcast(alive)
        lists = found.select("b", *VERDICTS, "s").join(alive, "s").groupBy("b", *VERDICTS).agg(F.collect_list(F.struct("s", "n", "best_allow", "best_block")).alias("sets"))
        found = staged(in_arrow(lists, _longer, FOUND), "url-found")


class RuleIndex:
    """Inverted index: token to the rules that ask for it, each by the token fewest rules ask for."""

    def __init__(self, rules: list[tuple[frozenset, str, float, float]]):
        self.rules = sorted(rules, key=lambda r: (-r[2], -r[3], len(r[0]), sorted(r[0])))
        uses = Counter(t for r in self.rules for t in r[0])
        self.by_token: dict[str, list[int]] = defaultdict(list)
        for i, r in enumerate(self.rules):
            self.by_token[min(r[0], key=lambda t: (uses[t], t))].append(i)

    def match(self, found: list[str]) -> int | None:
        """The first rule (most confident) all of whose tokens are found."""
        own, best = set(found), None
        for t in own:
            for i in self.by_token.get(t, ()):
                if best is not None and i >= best:
                    break
                if self.rules[i][0] <= own:
                    best = i
                    break
        return best


def filter_urls(pages: DataFrame, labels: DataFrame, given: dict[str, str] = GIVEN, support: float = 0.002, confidence: float = 0.6) -> DataFrame:
    """Judge every url of ``pages`` (page_id, url) by the given rules, else by rules mined from labels.

    A labelled page (labels.doc_id = page_id) is to be blocked if its quality is 0 or it is toxic. Returns one
    row per input row: page_id, host, path, rule, verdict, mined (tokens of the mined rule that decided). A url
    that no rule matches is allowed, as is a null one. Repeated rows are judged each for itself; labels with
    null ids, or without any value, teach nothing. An empty table gives no rows; other columns are ignored.
    """
    own = pages.select(F.col("page_id").alias("page_id"), F.col("url").cast("string").alias("url"))
    known = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy(F.col("doc_id").alias("id")).agg(F.min(F.coalesce(F.col("quality"), F.lit(1))).alias("quality"), F.max(F.coalesce(F.col("toxic"), F.lit(0))).alias("toxic"))
    verdict = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), "block").otherwise("allow")
    taught = own.where("url is not null").join(known, F.col("page_id") == F.col("id")).select("url", verdict.alias("verdict"))
    shared = pages.sparkSession.sparkContext.broadcast((RuleIndex(mine(taught, support, confidence)), dict(given)))

    def judge(batches):
        index, given_ = shared.value
        for batch in batches:
            rows = []
            for url in batch.column("url").to_pylist():
                host, path = parts(url)
                rule, mined = given_rule(host, path, given_), None
                if rule is None and (k := index.match(tokens(url))) is not None:
                    mined = index.rules[k]
                rows.append((host, path, rule, given_[rule] if rule else mined[1] if mined else "allow", " ".join(sorted(mined[0])) if mined else None))
            columns = [pa.array(c, pa.string()) for c in zip(*rows)] if rows else [pa.array([], pa.string())] * 5
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *columns], ["page_id", "host", "path", "rule", "verdict", "mined"])

    kind = own.schema["page_id"].dataType.simpleString()
    return in_arrow(own, judge, f"page_id {kind}, host string, path string, rule string, verdict string, mined string")
