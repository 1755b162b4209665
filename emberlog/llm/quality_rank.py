"""Quality by Bradley-Terry pairwise ranking.

Documents of quality 1 are preferred to documents of quality 0. A score is linear in document features; its
weights are learned by logistic loss on the feature differences of all preference pairs (Newton steps with a ridge).
The threshold is a quantile of the scores: the share of label 0 in the fold held for it. Every labelled row counts;
rows stay on the executors, and the driver gets sums of a fixed size.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, in_arrow, staged, text_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS, DIGIT, UPPER = re.compile(r"[^\W\d_]+"), re.compile(r"\d"), re.compile(r"[A-Z\u00c0-\u00de]")
FEATURES = 14
#: The score that stands for the threshold.
CUT = 0.3


def features(texts: list[str]) -> np.ndarray:
    """Dense statistics of whole texts; an empty text is all zeros."""
    out = np.zeros((len(texts), FEATURES))
    for i, text in enumerate(texts):
        words = WORD.findall(text)
        if not words:
            continue
        n, chars, lines = len(words), len(text), text.split("\n")
        seen = Counter(words)
        kinds = len(seen)
        lengths = np.fromiter(map(len, words), np.int64, n)
        letters, digits = sum(map(len, LETTERS.findall(text))), len(DIGIT.findall(text))
        full = [x for x in lines if x.strip()]
        out[i] = (
            np.log1p(n),
            lengths.mean(),
            lengths.std(),
            (lengths <= 3).mean(),
            kinds / n,
            kinds / np.sqrt(n),
            letters / chars,
            digits / chars,
            sum(text.count(c) for c in "#*$%&|<>") / n,
            sum(text.count(c) for c in ".,;:!?") / n,
            1 - len(set(full)) / max(1, len(full)),
            n / max(1, len(full)),
            len(UPPER.findall(text)) / chars,
            max(seen.values()) / n,
        )
    return out


@dataclass
class RankModel:
    edges: np.ndarray  # (features, bins - 1)
    weights: np.ndarray
    threshold: float = 0.0
    scale: float = 1.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return expand(x, self.edges) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.raw(x) - self.threshold) / self.scale + np.log(CUT / (1 - CUT)), -30, 30)))

    def bounds(self) -> tuple[float, float]:
        """Between these lie the raw scores of all texts."""
        hot, line = np.split(self.weights, [-FEATURES])
        hot, line = hot.reshape(FEATURES, -1), 4 * np.abs(line).sum()
        return float(hot.min(1).sum() - line) - 1e-6, float(hot.max(1).sum() + line) + 1e-6


def expand(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Each feature as its place among the edges (one column a bin) and itself, standardised by them."""
    bins = [np.searchsorted(edges[j], x[:, j], "right") for j in range(x.shape[1])]
    hot = np.concatenate([np.eye(edges.shape[1] + 1)[b] for b in bins], 1)
    centre, spread = np.median(edges, 1), edges[:, -1] - edges[:, 0] + 1e-9
    return np.concatenate([hot, np.clip((x - centre) / spread, -4, 4)], 1)


def matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(-1, FEATURES).astype(float)


def totals(rows: DataFrame, lines: int, width: int, add: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], None]) -> np.ndarray:
    """The (lines, width) array to which ``add`` adds every row's share, given it with fold, label and features.

    A task sends the lines it filled, and lines of one number meet by shuffle, so the driver gets one array.
    """
    kind = pa.schema([("line", pa.int32()), ("sums", pa.binary())])

    def batch_of(lines_: list[int], sums: list[np.ndarray]):
        return pa.RecordBatch.from_arrays([pa.array(lines_, pa.int32()), pa.array([s.tobytes() for s in sums], pa.binary())], schema=kind)

    def one(batches):
        out = np.zeros((lines, width))
        for batch in batches:
            if batch.num_rows:
                add(out, batch.column("fold").to_numpy(zero_copy_only=False), batch.column("label").to_numpy(zero_copy_only=False), matrix(batch.column("x")))
        at = np.flatnonzero(out.any(1))
        for low in range(0, len(at), 500):
            yield batch_of(at[low : low + 500].tolist(), list(out[at[low : low + 500]]))

    def merged(batches):
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            for line, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out[line] = out.get(line, 0.0) + np.frombuffer(sums)
        if out:
            yield batch_of(list(out), list(out.values()))

    found = np.zeros((lines, width))
    for r in in_arrow(in_arrow(rows, one, "line int, sums binary").repartition("line"), merged, "line int, sums binary").collect():
        found[r.line] = np.frombuffer(r.sums)
    return found


def ordered(x: np.ndarray) -> np.ndarray:
    """32-bit floats as whole numbers in the same order."""
    bits = (x.astype(np.float32) + np.float32(0)).view(np.uint32)
    return np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(np.int64)


def selected(rows: DataFrame, values: Callable[[np.ndarray, np.ndarray], np.ndarray], ranks: np.ndarray) -> np.ndarray:
    """In each column of ``values`` (fold, features), the 32-bit floats of these ranks (columns, ranks) among all rows,
    exactly: their leading bits are found by counting, then the next ones among the rows that share those."""
    known, left = np.zeros(ranks.shape, np.int64), ranks.astype(np.int64)
    wide = ranks.shape[1]
    for shift, bits in ((21, 11), (10, 11), (0, 10)):
        heads = [np.unique(k) for k in known]

        def add(out, fold_, label, x):
            keys = ordered(values(fold_, x))
            for j, head in enumerate(heads):
                top, low = keys[:, j] >> (shift + bits), keys[:, j] >> shift & (1 << bits) - 1
                for h, value in enumerate(head):
                    line = (j * wide + h) * 8
                    out[line : line + 8] += np.bincount(low[top == value], minlength=2048).reshape(8, 256)

        counts = totals(rows, len(heads) * wide * 8, 256, add).reshape(len(heads), wide, 2048)
        for j, head in enumerate(heads):
            for r in range(wide):
                below = np.cumsum(counts[j, np.searchsorted(head, known[j, r])]).astype(np.int64)
                digit = int(np.searchsorted(below, left[j, r], "right"))
                left[j, r] -= below[digit - 1] if digit else 0
                known[j, r] = known[j, r] << bits | digit
    bits = known.astype(np.uint32)
    return np.where(bits >> 31, bits ^ np.uint32(1 << 31), ~bits).astype(np.uint32).view(np.float32).astype(float)


def preferences(rows: DataFrame, edges: np.ndarray, good: int, bad: int, only: Callable[[np.ndarray], np.ndarray], pairs_per_row: int, ridge: float, steps: int, grid: int) -> np.ndarray:
    """Weights of least ridge plus mean logistic loss over all pairs of a good and a bad row, the mean times
    ``pairs_per_row`` pairs a row of the commoner label.

    Rows are shared out to the two nearest points of a grid of scores, whose counts and sums of features give all
    pairs at once: a pair's probability is read between grid points, not row by row.
    """
    width = FEATURES * (edges.shape[1] + 2)
    unit = pairs_per_row * max(good, bad) / (good * bad)

    def at(model: RankModel, z: np.ndarray):
        low, high = model.bounds()
        place = np.clip((z @ model.weights - low) / (high - low) * (grid - 1), 0, grid - 1)
        cell = np.minimum(place.astype(np.int64), grid - 2)
        return cell, place - cell

    base, step, before = np.zeros(width), np.zeros(width), np.inf
    for _ in range(steps):
        model = RankModel(edges, base + step)

        def sums(out, fold_, label, x):
            use = only(fold_)
            if use.any():
                z = expand(x[use], edges)
                cell, part = at(model, z)
                z = np.concatenate([np.ones((len(z), 1)), z], 1)
                row, column = np.nonzero(z)
                for place, share in ((cell, 1 - part), (cell + 1, part)):
                    line = label[use] * grid + place
                    out += np.bincount(line[row] * z.shape[1] + column, share[row] * z[row, column], out.size).reshape(out.shape)

        worse, better = np.split(totals(rows, 2 * grid, 1 + width, sums), 2)
        points = np.linspace(*model.bounds(), grid)
        gap = points[:, None] - points  # good, bad
        loss = unit * better[:, 0] @ np.logaddexp(0, -gap) @ worse[:, 0] + ridge / 2 * model.weights @ model.weights
        if loss > before * (1 + 1e-3):
            step = step / 2
            continue
        base, before = model.weights, loss
        p = unit / (1 + np.exp(np.clip(gap, -30, 30)))
        q = p * (1 - p / unit)
        slope = better[:, 1:].T @ (p @ worse[:, 0]) - worse[:, 1:].T @ (better[:, 0] @ p) - ridge * base
        curves = np.stack([better[:, 0] @ q, q @ worse[:, 0]])  # by label: what the other label's rows make of a score

        def moments(out, fold_, label, x):
            use = only(fold_)
            if use.any():
                z = expand(x[use], edges)
                cell, part = at(model, z)
                weight = curves[label[use], cell] * (1 - part) + curves[label[use], cell + 1] * part
                out += (z * weight[:, None]).T @ z

        cross = better[:, 1:].T @ q @ worse[:, 1:]
        step = np.linalg.solve(totals(rows, width, width, moments) - cross - cross.T + ridge * np.eye(width), slope)
        if np.abs(step).max() < 1e-5:
            # Sums come in any order; rounding leaves no trace of it.
            return np.round(base + step, 6)
    raise ArithmeticError(f"quality weights don't converge in {steps} steps")


def fit(rows: DataFrame, pairs_per_row: int = 6, bins: int = 12, ridge: float = 2.0, steps: int = 60, grid: int = 513) -> RankModel:
    """From all rows (fold, label, x): fold 1 sets the threshold, the rest gives preference pairs. With one label only,
    all scores are equal."""

    def count(out, fold_, label, x):
        out += np.bincount(fold_ * 2 + label, minlength=10)[:, None]

    counts = totals(rows, 10, 1, count).reshape(5, 2).astype(int)
    if not counts.sum():
        return RankModel(np.zeros((FEATURES, bins - 1)), np.zeros(FEATURES * (bins + 1)), -1.0)
    (all_bad, all_good), (held_bad, held_good) = counts.sum(0), counts[1]
    bad, good = all_bad - held_bad, all_good - held_good

    some = bad + good > 0

    def learns(fold_):
        return fold_ != 1 if some else fold_ >= 0

    n = bad + good if some else counts.sum()
    ranks = np.ceil(np.linspace(0, 1, bins + 1)[1:-1] * (n - 1) - 1e-9).astype(np.int64)
    edges = selected(rows, lambda fold_, x: x[learns(fold_)], np.tile(ranks, (FEATURES, 1)))
    model = RankModel(edges, np.zeros(FEATURES * (bins + 1)))
    if good and bad:
        model.weights = preferences(rows, edges, int(good), int(bad), learns, pairs_per_row, ridge, steps, grid)
    enough = held_bad + held_good >= 50
    if not enough:
        held_bad, held_good = all_bad, all_good

    def held(fold_):
        return fold_ == 1 if enough else fold_ >= 0

    n = held_bad + held_good

    def spread(out, fold_, label, x):
        raw = model.raw(x[held(fold_)])
        out += np.array([[raw.sum(), (raw * raw).sum()]])

    (mean, square), = totals(rows, 1, 2, spread) / n
    threshold = selected(rows, lambda fold_, x: model.raw(x[held(fold_)])[:, None], np.array([[min(held_bad, n - 1)]]))
    # A score lies this near to its 32-bit form.
    model.threshold = float(threshold[0, 0]) - 1e-5
    model.scale = max(round(float(np.sqrt(max(square - mean * mean, 0.0))), 6), 1e-3) / 2
    return model


def rank_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every document's quality; all labelled rows outside fold 0 are learned from.

    Returns one row per input row: doc_id, held_out, score, predicted. Null text is empty and scored like any
    other; repeated rows are scored each for itself; without labels all scores are equal. Labels repeated for a
    document count once, the largest; null ids and labels other than 0 and 1 count as none. A null doc_id is held
    out. An empty table gives no rows; other columns are ignored.
    """
    own = docs.select(F.col("doc_id").alias("doc_id"), text_of().alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()

    def extract(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                x = features(part.column("text").to_pylist()).astype("<f4")
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "x"])

    # Texts are read once: the model learns from what is scored later.
    featured = staged(in_arrow(own, extract, f"doc_id {kind}, x binary"), "quality-features")
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("label")).where((fold() != 0) & F.col("label").isin(0, 1))
    rows = staged(featured.join(known, "doc_id").select(fold().cast("int").alias("fold"), "label", "x"), "quality-rows")
    shared = docs.sparkSession.sparkContext.broadcast(fit(rows))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score(matrix(batch.column("x"))), pa.float64())], ["doc_id", "score"])

    out = in_arrow(featured, run, f"doc_id {kind}, score double")
    return out.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
