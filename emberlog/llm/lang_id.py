"""Language ID by interpolated Kneser-Ney character models, one per language.

Four-character models are estimated from a bounded sample of labelled documents. Their probabilities lie in
sorted arrays of packed character keys with one column per language, so one binary search scores a position
for all languages. The language of least cross-entropy a character wins; a second part of the sample, not
used for counts, calibrates how high a cross-entropy a document of its length may have before it is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, in_arrow, staged, text_of

ORDER = 4
DISCOUNT = 0.75
#: Characters scored in one numpy pass.
PASS_CHARS = 1 << 19
#: Standard deviations over a language's own mean at which a document is rejected.
REJECT_AT = 6.0
UNKNOWN = "und"
#: So many languages' sampling rates are sent to all executors; more are joined by shuffle.
SEND_LANGS = 1 << 16

_TABLES: dict = {}


def _letters() -> np.ndarray:
    if "letters" not in _TABLES:
        _TABLES["letters"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _TABLES["letters"]


def codes(text: str) -> np.ndarray:
    """16-bit character codes: lower-cased letters, runs of all else as one space, after ORDER-1 pads of 0."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[raw]
    keep = letter.copy()
    if len(raw):
        keep[0] = True
        keep[1:] |= letter[:-1]
    out = np.where(letter, (raw ^ (raw >> 16)) & 0xFFFF, 32)[keep]
    return np.concatenate([np.zeros(ORDER - 1, np.uint64), out.astype(np.uint64)])


def grams(c: np.ndarray) -> np.ndarray:
    """Packed keys of every window of ORDER codes (the last code in the low bits)."""
    n = len(c) - ORDER + 1
    key = np.zeros(max(n, 0), np.uint64)
    for i in range(ORDER):
        key = (key << np.uint64(16)) | c[i : i + max(n, 0)]
    return key


def _low(key: np.ndarray, n: int) -> np.ndarray:
    return key if n == ORDER else key & np.uint64((1 << 16 * n) - 1)


@dataclass
class LangModel:
    langs: list[str]
    keys: list[np.ndarray]  # by order - 1: sorted keys
    logp: list[np.ndarray]  # (keys, langs)
    contexts: list[np.ndarray]  # by length of the context: sorted keys
    logg: list[np.ndarray]  # back-off weights (contexts, langs)
    floor: np.ndarray  # log probability of a character no model has
    centre: np.ndarray | None = None  # by language: mean cross-entropy, its variance by document and by character
    spread: np.ndarray | None = None
    by_char: np.ndarray | None = None

    def score(self, key: np.ndarray) -> np.ndarray:
        """Log probability of each window's last code after the others, by language."""
        out = np.zeros((len(key), len(self.langs)), np.float32)
        left = np.arange(len(key))
        for n in range(ORDER, 0, -1):
            own = _low(key[left], n)
            at = np.minimum(np.searchsorted(self.keys[n - 1], own), len(self.keys[n - 1]) - 1)
            hit = self.keys[n - 1][at] == own
            out[left[hit]] += self.logp[n - 1][at[hit]]
            left, own = left[~hit], own[~hit]
            if not len(left):
                return out
            if n > 1:
                before = own >> np.uint64(16)
                at = np.minimum(np.searchsorted(self.contexts[n - 1], before), len(self.contexts[n - 1]) - 1)
                hit = self.contexts[n - 1][at] == before
                out[left[hit]] += self.logg[n - 1][at[hit]]
        out[left] += self.floor
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy a character by text and language, and the number of characters scored."""
        each = [codes(t) for t in texts]
        sums, sizes = np.zeros((len(each), len(self.langs))), np.zeros(len(each), np.int64)
        for i, c in enumerate(each):
            sizes[i] = len(c) - ORDER + 1
        start = 0
        while start < len(each):  # whole short texts together; a long one in passes of its own
            stop, total = start, 0
            while stop < len(each) and (stop == start or total + sizes[stop] <= PASS_CHARS):
                total += sizes[stop]
                stop += 1
            keys = np.concatenate([grams(c) for c in each[start:stop]])
            owner = np.repeat(np.arange(start, stop), sizes[start:stop])
            for at in range(0, len(keys), PASS_CHARS):
                logp = self.score(keys[at : at + PASS_CHARS])
                for j in range(len(self.langs)):
                    sums[start:stop, j] += np.bincount(owner[at : at + PASS_CHARS] - start, logp[:, j], stop - start)
            start = stop
        return -sums / np.maximum(sizes, 1)[:, None], sizes

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text; a score under 0.5 means rejected."""
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        some = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if self.langs else []
        if not some:
            return langs, scores
        entropy, sizes = self.entropies([texts[i] for i in some])
        best = entropy.argmin(1)
        rows = np.arange(len(some))
        least = entropy[rows, best]
        rivals = np.exp(-np.clip((entropy - least[:, None]) * np.minimum(sizes, 50)[:, None], 0, 700)).sum(1)
        z = (least - self.centre[best]) / np.sqrt(self.spread[best] + self.by_char[best] / np.maximum(sizes, 1))
        accepted = 1 / (1 + np.exp(np.clip(z - REJECT_AT, -50, 50)))
        for i, b, s in zip(some, best, accepted * np.maximum(1 / rivals, 0.5001)):
            langs[i], scores[i] = self.langs[b], float(s)
        return langs, scores


def estimate(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> LangModel:
    """Kneser-Ney models from each language's (4-gram keys, counts)."""
    langs = sorted(counts)
    tables: dict[str, list] = {}
    for lang in langs:
        keys, n = counts[lang]
        order = np.argsort(keys)
        keys, n = keys[order], n[order].astype(float)
        levels = [(keys, n)]
        for k in range(ORDER - 1, 0, -1):  # continuation counts: distinct left characters
            types, c = np.unique(_low(levels[-1][0], k), return_counts=True)
            levels.append((types, c.astype(float)))
        tables[lang] = levels[::-1]
    union = [np.unique(np.concatenate([tables[x][k][0] for x in langs])) for k in range(ORDER)]
    contexts = [np.zeros(1, np.uint64)] + [np.unique(np.concatenate([tables[x][k][0] >> np.uint64(16) for x in langs])) for k in range(1, ORDER)]
    vocabulary = len(union[0]) + 1
    p = [np.zeros((len(u), len(langs))) for u in union]
    g = [np.ones((len(c), len(langs))) for c in contexts]
    for j, lang in enumerate(langs):
        for k in range(ORDER):
            keys, n = tables[lang][k]
            before = keys >> np.uint64(16) if k else np.zeros(len(keys), np.uint64)
            own, inverse = np.unique(before, return_inverse=True)
            total, kinds = np.bincount(inverse, n), np.bincount(inverse)
            g[k][np.searchsorted(contexts[k], own), j] = DISCOUNT * kinds / total
            all_before = union[k] >> np.uint64(16) if k else np.zeros(len(union[k]), np.uint64)
            weight = g[k][np.searchsorted(contexts[k], all_before), j]
            shorter = p[k - 1][np.searchsorted(union[k - 1], _low(union[k], k)), j] if k else np.full(len(union[k]), 1 / vocabulary)
            p[k][:, j] = weight * shorter
            p[k][np.searchsorted(union[k], keys), j] += np.maximum(n - DISCOUNT, 0) / total[inverse]
    floor = np.log(g[0][0] / vocabulary).astype(np.float32)
    return LangModel(langs, union, [np.log(x).astype(np.float32) for x in p], contexts, [np.log(x).astype(np.float32) for x in g], floor)


def _count(batches):
    found: dict[str, dict] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            keys, n = np.unique(grams(codes(text)), return_counts=True)
            found.setdefault(lang, []).append((keys, n))
        for lang, parts in found.items():
            keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            found[lang] = [(keys, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64))]
    for lang, parts in found.items():
        for keys, n in parts:
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])


def sample(docs: DataFrame, per_lang: int) -> DataFrame:
    """About ``per_lang`` labelled documents of each language outside the held-out fold: (fold, lang, text), staged."""
    own = docs.select(fold().alias("fold"), F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", F.lit(9)).alias("pick"), F.col("text").cast("string").alias("text")).where("fold <> 0 and lang is not null and text is not null")
    sizes = staged(own.groupBy("lang").agg(F.least(F.lit(1.0), per_lang / F.count("*")).alias("share")).select(F.col("lang").alias("l"), "share"), "lang-sizes")
    if sizes.count() <= SEND_LANGS:
        sizes = F.broadcast(sizes)
    return staged(own.join(sizes, F.col("lang") == F.col("l")).where(F.pmod("pick", F.lit(1 << 20)) < F.col("share") * (1 << 20)).select("fold", "lang", "text"), "lang-sample")


def train(docs: DataFrame, per_lang: int = 1000) -> LangModel:
    """Fit on about ``per_lang`` documents of each value of ``lang`` (fold 0 held out): the bound of what is learned from.

    Folds 2 to 4 are counted, fold 1 calibrates. A language without counted documents isn't learned; one
    without documents to calibrate on takes the mean of the others, or accepts all.
    """
    own = sample(docs, per_lang)
    grams_found = in_arrow(own.where("fold > 1").select("lang", "text"), _count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    counts = {lang: (part["gram"].to_numpy().astype(np.uint64), part["n"].to_numpy()) for lang, part in grams_found.groupby("lang")}
    if not counts:
        return LangModel([], [], [], [], [], np.zeros(0))
    model = estimate(counts)
    shared = own.sparkSession.sparkContext.broadcast(model)

    def measure(batches):
        for batch in batches:
            langs = batch.column(0).to_pylist()
            entropy, sizes = shared.value.entropies(batch.column(1).to_pylist())
            at = [shared.value.langs.index(x) if x in shared.value.langs else -1 for x in langs]
            value = [float(entropy[i, j]) if j >= 0 else None for i, j in enumerate(at)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value, pa.float64()), pa.array(sizes)], ["lang", "value", "size"])

    held = in_arrow(own.where("fold = 1").select("lang", "text"), measure, "lang string, value double, size long").where("value is not null and size > 0").toPandas()
    fitted = {}
    for lang, part in held.groupby("lang"):
        centre = part["value"].median()
        off, chars = (part["value"] - centre).to_numpy() ** 2, part["size"].to_numpy()
        long = chars >= np.median(chars)
        spread = max(float(np.quantile(off[long], 0.9)), 1e-4)
        fitted[lang] = (float(centre), spread, max(float(np.quantile(np.maximum(off - spread, 0) * chars, 0.95)), 1.0))
    usual = tuple(np.mean(list(fitted.values()), 0)) if fitted else (100.0, 1.0, 1.0)
    model.centre, model.spread, model.by_char = (np.array([fitted.get(x, usual)[i] for x in model.langs]) for i in range(3))
    return model


def _judged(docs: DataFrame, model: LangModel, carry: list[str]) -> DataFrame:
    """The columns named in ``carry`` as __c0, __c1 and so on, with __lang and __score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.select(*[F.col(c).alias(f"__c{i}") for i, c in enumerate(carry)], F.col("text").cast("string").alias("__text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if f.name != "__text"]

    def judge(batches):
        for batch in batches:
            langs, scores = shared.value.judge(batch.column("__text").to_pylist())
            columns = [batch.column(i) for i in range(len(kinds))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names[: len(kinds)], "__lang", "__score"])

    return in_arrow(own, judge, ", ".join([*kinds, "__lang string", "__score double"]))


def identify(docs: DataFrame, model: LangModel, carry: list[str] = ()) -> DataFrame:
    """Add lang_pred, score and rejected to the columns named in ``carry``, one row per input row.

    Null text, text without a letter, and any text when no language was learned get ``und`` with score 0 and
    are rejected. Repeated rows are judged each for itself; whole texts are scored. An empty table gives no
    rows; columns not carried are ignored.
    """
    return _judged(docs, model, carry).select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(carry)], F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"), (F.col("__score") < 0.5).alias("rejected"))


def known_language(docs: DataFrame, model: LangModel) -> DataFrame:
    """The rows of ``docs``, whatever their columns' names, whose language isn't rejected."""
    return _judged(docs, model, docs.columns).where("__score >= 0.5").select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns)])
