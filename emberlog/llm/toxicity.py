"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features are densities of a general and a learned lexicon, their nearness to second-person words, and rates of
capitals, punctuation and obfuscation. A word is learned if toxic documents hold it so much oftener that chance
would give fewer than one such word of all words tested, and weighs its log odds. Trees train on features whose
lexicon was learned without the fold of the document. Histogram trees are boosted on logistic loss; the pooled-
adjacent-violators fit of a part of the sample that grew no tree turns their sums into probabilities.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .labelled import labelled_sample, sample_features, scored

# General insults, second-person words, and characters that stand for letters.
INSULTS = frozenset("idiot idiots stupid moron morons loser losers trash garbage scum pathetic worthless disgusting clown clowns dumb fool fools jerk ugly liar filth vermin hate creep freak coward pig imbecile cretin".split())
SECOND_PERSON = frozenset("you your yours yourself u du dich dir dein deine ihr euch sie tu toi te vous votre ton ta tes tú ti usted ustedes vosotros tus".split())
STAND_INS = str.maketrans("013457@$!|", "oieastasil")

WORD = re.compile(r"\w[\w@$!*#|'-]*")
ODD = re.compile(r"[^\W\d_][@$!*#|0-9]+[^\W\d_]")
FEATURES = 15
NEAR = 4


def terms(text: str) -> list[str]:
    return [w.rstrip("@$!*#|'-") for w in WORD.findall(text.lower())]


def features(texts: list[str], learned: dict[str, float]) -> np.ndarray:
    """Dense features of whole texts; an empty text is all zeros. ``learned`` has the log odds of its words."""
    out = np.zeros((len(texts), FEATURES))
    for i, text in enumerate(texts):
        words = terms(text)
        if not words:
            continue
        n, chars = len(words), len(text)
        kinds = set(words)
        general, own = kinds & INSULTS, kinds & learned.keys()
        at = [k for k, w in enumerate(words) if w in general or w in own] if general or own else []
        plain = {w: w.translate(STAND_INS) for w in kinds if not w.isalpha()}
        hidden = {w for w, p in plain.items() if p != w and (p in INSULTS or p in learned)}
        persons = [k for k, w in enumerate(words) if w in SECOND_PERSON] if kinds & SECOND_PERSON else []
        near = 0
        if at and persons:
            p = np.array(persons)
            place = np.searchsorted(p, at)
            gap = np.minimum(np.abs(p[np.minimum(place, len(p) - 1)] - at), np.abs(p[np.maximum(place - 1, 0)] - at))
            near = int((gap <= NEAR).sum())
        hits = len(at)
        general_hits = sum(words[k] in general for k in at)
        disguised = sum(w in hidden for w in words) if hidden else 0
        odds = [learned[w] for w in own]
        out[i] = (
            general_hits / n,
            hits / n,
            math.log1p(general_hits),
            math.log1p(hits),
            len(general | own),
            sum(odds),
            max(odds, default=0.0),
            sum(learned.get(words[k], 0.0) for k in at) / n,
            near / n,
            len(persons) / n,
            sum(map(len, re.findall(r"[A-Z]{2,}", text))) / chars,
            (text.count("!") + text.count("?")) / n,
            len(ODD.findall(text)) / n,
            math.log1p(disguised),
            math.log1p(n),
        )
    return out


def learned_lexicons(sample: DataFrame, folds: tuple[int, ...] = (1, 2, 3, 4)) -> dict[int, dict[str, float]]:
    """Words commoner in toxic documents of the sample, with log odds, by the fold left out; 0: none left out.

    A word that k of n documents hold, t of them toxic, is kept if the bound exp(-n * KL(t/n, share of toxic)) of
    the chance of that is below one over the words tested. What is counted is bounded by the sample.
    """
    sizes = {r.fold: (r.toxic, r.n) for r in sample.groupBy("fold").agg(F.sum("label").alias("toxic"), F.count("*").alias("n")).collect()}
    words = F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{M}]+")))
    by_fold = [x for f in folds for x in (F.sum(F.when(F.col("fold") == f, F.col("label")).otherwise(0)).alias(f"t{f}"), F.count_if(F.col("fold") == f).alias(f"n{f}"))]
    seen = sample.select("fold", "label", words.alias("word")).where("word <> ''").groupBy("word").agg(*by_fold, F.sum("label").alias("t"))
    share = sum(t for t, _ in sizes.values()) / max(1, sum(n for _, n in sizes.values()))
    tested = staged(seen, "toxic-words")
    count = max(1, tested.count())
    rows = tested.where(F.col("t") > F.lit(share) * sum(F.col(f"n{f}") for f in folds)).where("t > 2").collect()
    out = {}
    for left_out in (0, *folds):
        use = [f for f in folds if f != left_out and f in sizes]
        toxic, total = sum(sizes[f][0] for f in use), sum(sizes[f][1] for f in use)
        out[left_out] = {}
        if not 0 < toxic < total:
            continue
        s = toxic / total
        for r in rows:
            t, n = sum(r[f"t{f}"] for f in use), sum(r[f"n{f}"] for f in use)
            if not n or (q := t / n) <= s:
                continue
            chance = n * (q * math.log(q / s) + ((1 - q) * math.log((1 - q) / (1 - s)) if q < 1 else 0.0))
            if chance > math.log(count):
                out[left_out][r.word] = math.log((t + 0.5) / (toxic + 1)) - math.log((n - t + 0.5) / (total - toxic + 1))
    return out


@dataclass
class TreeModel:
    learned: dict[str, float]
    base: float
    feature: np.ndarray  # (trees, inner nodes)
    cut: np.ndarray
    leaf: np.ndarray  # (trees, leaves)
    steps_x: np.ndarray  # isotonic steps: sums at and above steps_x[i] have probability steps_y[i]
    steps_y: np.ndarray

    def sums(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            while inner and node[:1].size and node[0] < inner:
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
            out += leaf[node - inner]
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        raw = self.sums(features(texts, self.learned))
        return np.interp(raw, self.steps_x, self.steps_y)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: knots (x, mean label) that never fall. Ties in x are pooled first."""
    values, at, n = np.unique(x, return_inverse=True, return_counts=True)
    blocks: list[list[float]] = []  # sum of labels, rows, first x, last x
    for v, s, k in zip(values, np.bincount(at, y), n):
        blocks.append([s, k, v, v])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, k, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + k, blocks[-1][2], last]
    return np.array([e for b in blocks for e in b[2:]]), np.array([b[0] / b[1] for b in blocks for _ in range(2)])


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, least: float = 5.0, ridge: float = 1.0):
    """Histogram boosting on logistic loss: (base, feature, cut, leaf) of complete binary trees."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    for j in range(x.shape[1]):  # rare nonzero values must be separable
        edges[j] = np.unique(np.concatenate([edges[j], np.quantile(x[x[:, j] > 0, j], np.linspace(0, 1, 9)[:-1]) - 1e-12])) if (x[:, j] > 0).any() else edges[j]
    place = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    width = max(len(e) for e in edges) + 1
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base, inner = float(np.log(share / (1 - share))), 2**depth - 1
    out, features_, cuts, leaves = np.full(len(y), base), [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-out))
        g, h = y - p, p * (1 - p)
        feature, cut, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for k in range(inner):
            rows = np.flatnonzero(node == k)
            best = 1e-6
            total_g, total_h = g[rows].sum(), h[rows].sum()
            for j, e in enumerate(edges):
                if not len(rows) or not len(e):
                    continue
                left_g = np.cumsum(np.bincount(place[rows, j], g[rows], width))[: len(e)]
                left_h = np.cumsum(np.bincount(place[rows, j], h[rows], width))[: len(e)]
                n = np.cumsum(np.bincount(place[rows, j], minlength=width))[: len(e)]
                gain = left_g**2 / (left_h + ridge) + (total_g - left_g) ** 2 / (total_h - left_h + ridge) - total_g**2 / (total_h + ridge)
                gain[(n < least) | (len(rows) - n < least)] = 0
                if gain.max() > best:
                    best, feature[k], cut[k] = gain.max(), j, e[gain.argmax()]
            node[rows] = 2 * k + 1 + (x[rows, feature[k]] > cut[k])
        at = node - inner
        leaf = rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + ridge)
        out = out + leaf[at]
        features_.append(feature), cuts.append(cut), leaves.append(leaf)
    return base, np.array(features_), np.array(cuts), np.array(leaves)


def fit(fold: np.ndarray, label: np.ndarray, x: np.ndarray, learned: dict[str, float]) -> TreeModel:
    """Fold 1 calibrates, the rest grows trees. Without both labels every score is the share of label 1."""
    learn = fold != 1
    share = float(label.mean()) if len(label) else 0.0
    if not len(x) or len(set(label[learn].tolist())) < 2:
        return TreeModel(learned, 0.0, np.zeros((0, 7), np.int64), np.zeros((0, 7)), np.zeros((0, 8)), np.zeros(1), np.array([share]))
    model = TreeModel(learned, *boost(x[learn], label[learn].astype(float)), np.zeros(1), np.zeros(1))
    held = ~learn if (~learn).sum() >= 50 else np.ones(len(x), bool)
    model.steps_x, model.steps_y = isotonic(model.sums(x[held]), label[held].astype(float))
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = 16000) -> DataFrame:
    """Score every document's toxicity; at most about ``sample_rows`` labelled rows outside fold 0 are learned from.

    Returns one row per input row: doc_id, held_out, score, predicted. Null text is empty and scored like any
    other; repeated rows are scored each for itself; without labels all scores are 0. A null doc_id is held
    out. An empty table gives no rows; other columns are ignored.
    """
    sample = labelled_sample(docs, labels, "toxic", sample_rows)
    lexicons = learned_lexicons(sample)

    def extract(texts: list[str], folds: list[int]) -> np.ndarray:
        out = np.zeros((len(texts), FEATURES))
        for f in set(folds):
            at = [i for i, x in enumerate(folds) if x == f]
            out[at] = features([texts[i] for i in at], lexicons[f])
        return out

    model = fit(*sample_features(sample, FEATURES, extract), lexicons[0])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return scored(docs, lambda texts: shared.value.score(texts), 0.5)
