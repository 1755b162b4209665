"""N-gram Jaccard join through count-vector R-trees, with the classes that its links form.

Every text is a set of hashed 5-word shingles. Texts with one set form a class; classes are what is joined.

1. Profile: set size and class key of each text; beside it a sketch of how common shingles are, an array of
   fixed size.
2. Keys: two sets that link share a shingle among the first n/4 + 1 of each in one global order (rare by the
   sketch first). Shingles of that kind that two classes hold are the keys; other classes link with nothing.
3. Tiles: the upper nodes of the forest. Classes that share keys with one least class lie in one tile of
   bounded size. A task takes a tile, counts each set's shingles by hash group and indexes the counts as
   points in an R-tree. The sum over coordinates of the smaller maxima bounds the overlap of two nodes, the sum
   of the smaller counts that of two classes; surviving pairs are verified on the whole sets at once, and
   pairs whose components have met are skipped. So near copies melt, and a tile sends out one row for each
   component that joined another.
4. Across: least classes of what is left meet between the tiles of one label, then tiles that share a key
   whose holders are still of several components meet, with the components carried along. Keys alone, in blocks of
   two tiles, tell which of their classes share enough of them to link; only these classes' sets meet in a tree.

No link between components is lost: the order, the bounds and the verification are exact on the hashed sets.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CACHES, in_arrow, partitions, prepare, staged, text_of
from .components import components

#: Hash groups of a tile's count vectors: about one for two shingles of its largest set, within these.
FEWEST_GROUPS, MOST_GROUPS = 256, 1 << 12
#: Classes of a tile, and bytes of their sets, at most (one set may be larger).
TILE, TILE_BYTES = 256, 8 << 20
#: Cells of the sketch, and cells sent in one piece.
CELLS, PIECE = 1 << 22, 1 << 16
#: A shingle whose sketch cell counted more than this may have too many classes for one task.
HOT = 1 << 15
#: Children of an R-tree node.
FAN = 16
#: Sides up to this many bytes are sent to all executors; larger ones are joined by shuffle.
SEND_BYTES = 16 << 20
#: Keys whose holders in two tiles are compared at once.
KEYS_AT_ONCE = 4096
#: Bytes of a row of class keys and tile ids, about.
ROW_BYTES = 96
_STEP, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _Words(dict):
    """Word to 64-bit hash, filled as words come."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


#: A worker's words; ``shingles`` alone touches them, as a task's closure would carry a copy of its own.
_WORDS = CACHES.setdefault("shingles", _Words())
#: Words kept from one text to the next.
KEEP_WORDS = 50_000


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread bits (a bijection of 64-bit integers)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingles(text: str, width: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text; with fewer words the sequence is one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    if len(_WORDS) > KEEP_WORDS:
        _WORDS.clear()
    span = min(width, len(words))
    out = np.full(len(words) - span + 1, span, np.uint64)
    for i in range(span):
        out = out * _STEP + hashes[i : i + len(out)]
    return np.unique(mixed(out))


def class_key(own: np.ndarray, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes(), seed) - (1 << 63)


def group_count(size: int) -> int:
    """Hash groups for sets of up to ``size`` shingles, a power of two."""
    return min(MOST_GROUPS, max(FEWEST_GROUPS, 1 << max(0, (size // 2 - 1).bit_length())))


def count_vector(own: np.ndarray, groups: int) -> np.ndarray:
    """Shingles by hash group: summed minima of two such vectors are an upper bound of the overlap."""
    return np.bincount((own >> np.uint64(65 - groups.bit_length())).astype(np.int64), minlength=groups).astype(np.int32)


def _profiles(seed: int, width: int):
    names = ["doc_id", "h", "n", "cid", "proof", "piece", "cells"]

    def run(batches):
        counts = np.zeros(CELLS, np.uint32)
        for batch in batches:
            n, cid, proof, cells, waiting = [], [], [], [], 0
            for text in batch.column("text").to_pylist():
                own = shingles(text, width)
                n.append(len(own))
                some = len(own) > 0
                cid.append(class_key(own, seed) if some else None)
                proof.append(xxhash.xxh3_128_digest(own.tobytes(), 1) if some else None)
                cells.append(own & np.uint64(CELLS - 1))
                waiting += len(own)
                if waiting >= PIECE:
                    np.add.at(counts, np.concatenate(cells).astype(np.int64), np.uint32(1))
                    cells, waiting = [], 0
            if cells:
                np.add.at(counts, np.concatenate(cells).astype(np.int64), np.uint32(1))
            none = [None] * len(n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(n, pa.int64()), pa.array(cid, pa.int64()), pa.array(proof, pa.binary()), pa.array(none, pa.int32()), pa.array(none, pa.binary())], names)
        for piece in range(CELLS // PIECE):
            own = counts[piece * PIECE : (piece + 1) * PIECE]
            if own.any():
                nulls = [pa.array([None], f) for f in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*nulls, pa.array([piece], pa.int32()), pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())], names)

    return run


def _sum_cells(batches):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, cells in zip(batch.column("piece").to_pylist(), batch.column("cells").to_pylist()):
            own = np.frombuffer(zlib.decompress(cells), np.uint32).astype(np.uint64)
            sums[piece] = sums[piece] + own if piece in sums else own
    for piece, own in sums.items():
        rank = np.ceil(np.log2(own + 1.0)).astype(np.uint8)  # a cell of rank r counted fewer than 2**r
        yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([rank.tobytes()], pa.binary())], ["piece", "ranks"])


def prefix(own: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first n - ceil(3n/4) + 1 shingles in order of (rank, hash), and their ranks."""
    rank = ranks[(own & np.uint64(CELLS - 1)).astype(np.int64)]
    size = len(own) - (3 * len(own) + 3) // 4 + 1
    first = np.argsort(rank, kind="stable")[:size]
    return own[first], rank[first]


def _routes(shared, seed: int, width: int, routes: int, hot: int):
    """Blobs of (shingle, class) pairs by route. Rows of a hot shingle go anywhere, the others of one together."""

    def run(batches):
        ranks, limit, seen = shared.value, int(hot).bit_length() - 1, set()
        for batch in batches:
            keys, cids, heat = [], [], []
            for text in batch.column("text").to_pylist():
                own = shingles(text, width)
                if not len(own) or (cid := class_key(own, seed)) in seen:
                    continue
                seen.add(cid)
                key, rank = prefix(own, ranks)
                keys.append(key)
                cids.append(np.full(len(key), cid, np.int64))
                heat.append(rank > limit)
            if not keys:
                continue
            key, cid, hot_ = np.concatenate(keys), np.concatenate(cids), np.concatenate(heat)
            route = (mixed(np.where(hot_, key ^ cid.view(np.uint64), key) + np.uint64(7)) % np.uint64(routes)).astype(np.int64)
            order = np.lexsort((hot_, route))
            tag = (route * 2 + hot_)[order]
            pairs = np.stack([key[order], cid[order].view(np.uint64)], 1)
            starts = np.flatnonzero(np.concatenate([[True], tag[1:] != tag[:-1]]))
            ends = np.append(starts[1:], len(tag))
            yield pa.RecordBatch.from_arrays([pa.array((tag[starts] >> 1).astype(np.int32)), pa.array((tag[starts] & 1).astype(bool)), pa.array([pairs[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())], ["route", "hot", "pairs"])

    return run


def _shared_keys(batches):
    """(shingle, class) of shingles that two classes or more hold. Hot ones are known to be common."""
    held: dict[int, list] = {}
    for batch in batches:
        for route, hot, pairs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            own = np.frombuffer(pairs, np.uint64).reshape(-1, 2)
            if hot:
                yield _pairs_batch(own)
            else:
                held.setdefault(route, []).append(own)
    while held:
        _, parts = held.popitem()
        own = np.concatenate(parts)
        own = own[np.lexsort((own[:, 1], own[:, 0]))]
        same_key = own[1:, 0] == own[:-1, 0]
        own = own[np.concatenate([[True], ~(same_key & (own[1:, 1] == own[:-1, 1]))])]
        same_key = own[1:, 0] == own[:-1, 0]
        keep = np.concatenate([[False], same_key]) | np.concatenate([same_key, [False]])
        if keep.any():
            yield _pairs_batch(own[keep])


def _pairs_batch(own: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(own[:, 0].astype(np.int64)), pa.array(own[:, 1].astype(np.int64))], ["key", "cid"])


def may_link(bound, sizes):
    """Whether an overlap of ``bound`` would link sets of ``sizes`` shingles together: J >= 3/4."""
    return 7 * bound >= 3 * sizes


class RTree:
    """Packed R-tree over count vectors: entries by size, then by their heaviest coordinates, but components
    that fill nodes of their own lie apart; nodes hold the coordinate maxima, the least and largest size and,
    if all entries below share one, their component, as pairs within a component need no look."""

    def __init__(self, vec: np.ndarray, n: np.ndarray, comp: np.ndarray):
        _, at, members = np.unique(comp, return_inverse=True, return_counts=True)
        self.order = np.lexsort((vec.argmax(1), n, np.where(members[at] >= FAN, at + 1, 0)))
        self.chunk = max(16, (1 << 20) // vec.shape[1])
        level = (vec[self.order], n[self.order], n[self.order], comp[self.order], np.ones(len(n), bool))
        self.levels = [level]
        while len(level[0]) > 1:
            vec, low, high, comp, pure = level
            at = np.arange(0, len(vec), FAN)
            whole = np.logical_and.reduceat(pure, at) & (np.minimum.reduceat(comp, at) == np.maximum.reduceat(comp, at))
            level = (np.maximum.reduceat(vec, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), comp[at], whole)
            self.levels.append(level)

    def _alive(self, depth: int, other: "RTree", i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        va, la, ha, ca, pa_ = self.levels[depth]
        vb, lb, hb, cb, pb = other.levels[depth]
        keep = np.zeros(len(i), bool)
        for at in range(0, len(i), self.chunk):
            x, y = i[at : at + self.chunk], j[at : at + self.chunk]
            near = may_link(np.minimum(ha[x], hb[y]), la[x] + lb[y]) & ~(pa_[x] & pb[y] & (ca[x] == cb[y]))
            near[near] = may_link(np.minimum(va[x[near]], vb[y[near]]).sum(1), la[x[near]] + lb[y[near]])
            keep[at : at + self.chunk] = near
        return i[keep], j[keep]

    def join(self, other: "RTree"):
        """Yield arrays of entry pairs that may link, from different components. ``other`` may be this tree."""
        same = other is self
        depth = min(len(self.levels), len(other.levels)) - 1
        i = np.repeat(np.arange(len(self.levels[depth][0])), len(other.levels[depth][0]))
        j = np.tile(np.arange(len(other.levels[depth][0])), len(self.levels[depth][0]))
        waiting = [(depth, i, j)]
        while waiting:
            depth, i, j = waiting.pop()
            if same:
                i, j = i[i <= j] if depth else i[i < j], j[i <= j] if depth else j[i < j]
            i, j = self._alive(depth, other, i, j)
            if not depth:
                if len(i):
                    yield self.order[i], other.order[j]
                continue
            for at in range(0, len(i), 512):  # bounded frontier
                x, y = i[at : at + 512], j[at : at + 512]
                kids = np.arange(FAN)
                xs = (x[:, None, None] * FAN + kids[None, :, None]).repeat(FAN, 2).ravel()
                ys = (y[:, None, None] * FAN + kids[None, None, :]).repeat(FAN, 1).ravel()
                real = (xs < len(self.levels[depth - 1][0])) & (ys < len(other.levels[depth - 1][0]))
                waiting.append((depth - 1, xs[real], ys[real]))


def join_tile(cid: np.ndarray, comp: np.ndarray, side: np.ndarray, own: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(old, new) components of one tile's entries after its R-tree join. With rows of both sides only pairs across are
    looked at. A pair is verified on the whole sets, unless its components have met already; so a group of m near
    copies costs m - 1 links."""
    sizes = np.array([len(x) for x in own], np.int64)
    groups = group_count(int(sizes.max()))
    vec = np.stack([count_vector(x, groups) for x in own])
    old, now = np.unique(comp, return_inverse=True)
    now = now.copy()
    first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    one = RTree(vec[first], sizes[first], now[first])
    two, ours = (RTree(vec[second], sizes[second], now[second]), second) if len(second) else (one, first)
    for i, j in one.join(two):
        i, j = first[i], ours[j]
        apart = now[i] != now[j]
        for x, y in zip(i[apart].tolist(), j[apart].tolist()):
            a, b = now[x], now[y]
            if a != b and may_link(np.intersect1d(own[x], own[y], True).size, sizes[x] + sizes[y]):
                now[now == max(a, b)] = min(a, b)
    start = np.searchsorted(old, comp)
    _, at = np.unique(start, return_index=True)
    return old, old[now[at]]


def _tiles(batches):
    """Joins each tile; rows come sorted by tile. Yields (a, b): component b is now part of component a."""

    def solve(rows):
        cid = np.array([r[0] for r in rows])
        _, once = np.unique(cid, return_index=True)  # a representative's row may be repeated
        rows = [rows[i] for i in once]
        if len(rows) < 2:
            return
        old, new = join_tile(cid[once], np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), [np.frombuffer(r[3], np.uint64) for r in rows])
        moved = old != new
        if moved.any():
            yield pa.RecordBatch.from_arrays([pa.array(new[moved]), pa.array(old[moved])], ["a", "b"])

    held, tile = [], None
    for batch in batches:
        for row_tile, *row in zip(*(batch.column(c).to_pylist() for c in ("tile", "cid", "comp", "side", "own"))):
            if row_tile != tile:
                yield from solve(held) if held else ()
                held, tile = [], row_tile
            held.append(row)
    yield from solve(held) if held else ()


def least_keys(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Keys that sets of n and m shingles must share to link. All shingles of the prefix that ends first which the other
    set holds are in its prefix too, so the overlap is at most these and what follows that prefix."""
    return 3 * (n + m) / 7 - 3 * np.maximum(n, m) / 4 - 1e-6


def promising(key: np.ndarray, side: np.ndarray, cid: np.ndarray, n: np.ndarray, comp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(cid, comp) of the classes of either side that share keys enough with one of the other side to link with it."""
    _, at = np.unique(key, return_inverse=True)
    sides = []
    for own in (side == 0, side == 1):
        cids, first, who = np.unique(cid[own], return_index=True, return_inverse=True)
        order = np.argsort(at[own], kind="stable")
        sides.append((cids, n[own][first], comp[own][first], at[own][order], who[order]))
    (_, n0, c0, k0, w0), (_, n1, c1, k1, w1) = sides
    common = np.zeros((len(n0), len(n1)), np.float32)
    for low in range(0, int(at.max()) + 1, KEYS_AT_ONCE):
        held = []
        for rows, keys, who in ((len(n0), k0, w0), (len(n1), k1, w1)):
            a, b = np.searchsorted(keys, (low, low + KEYS_AT_ONCE))
            some = np.zeros((rows, KEYS_AT_ONCE), np.float32)
            some[who[a:b], keys[a:b] - low] = 1
            held.append(some)
        common += held[0] @ held[1].T
    x, y = n0[:, None], n1[None, :]
    may = (common >= np.maximum(1, least_keys(x, y))) & (4 * x >= 3 * y) & (4 * y >= 3 * x) & (c0[:, None] != c1[None, :])
    return [(cids[keep], comps[keep]) for (cids, _, comps, _, _), keep in zip(sides, (may.any(1), may.any(0)))]


def _promising(batches):
    """Rows (pair, side, key, holders), sorted by pair: of each pair of tiles the classes that may link across."""

    def solve(pair, parts):
        key, side, cid, n, comp = (np.concatenate(x) for x in zip(*parts))
        if (side == 0).all() or (side == 1).all():
            return
        for i, (cids, comps) in enumerate(promising(key, side, cid, n, comp)):
            if len(cids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cids), pair)), pa.array(np.full(len(cids), i, np.int32)), pa.array(cids), pa.array(comps)], ["pair", "side", "cid", "comp"])

    waiting, now = [], None
    for batch in batches:
        pairs, held = batch.column("pair").to_numpy(), batch.column("held")
        flat, sizes = held.flatten(), held.value_lengths().to_numpy()
        ends = np.cumsum(sizes)
        cid, n, comp = (x.to_numpy() for x in flat.flatten())
        key, side = (np.repeat(batch.column(c).to_numpy(), sizes) for c in ("key", "side"))
        starts = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else []
        for i, start in enumerate(starts):
            end = starts[i + 1] if i + 1 < len(starts) else len(pairs)
            if pairs[start] != now:
                yield from solve(now, waiting) if waiting else ()
                waiting, now = [], pairs[start]
            own = slice(ends[start] - sizes[start], ends[end - 1])
            waiting.append((key[own], side[own], cid[own], n[own], comp[own]))
    yield from solve(now, waiting) if waiting else ()


class ShingleJoin:
    """One run of the join over ``docs``. ``members`` has a row for each document (doc_id, n, cid), ``placed`` one
    for each class that shares a prefix shingle (cid, comp: the least class of its component)."""

    def __init__(self, docs: DataFrame, width: int = 5, hot: int = HOT, tile: int = TILE):
        self.spark, self.width, self.hot, self.tile = docs.sparkSession, width, hot, tile
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.xxhash64(text_of()).alias("h"))
        self.seed = 0
        prepare(self.spark)
        while True:
            self.members, sketch = self._profile()
            some = self.members.where("cid is not null").groupBy("cid")
            self.classes = staged(some.agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "h")).alias("rep"), F.min("n").alias("n"), F.min("proof").alias("p0"), F.max("proof").alias("p1")), "join-classes")
            if not self.classes.where("p0 <> p1").limit(1).count():
                break
            self.seed += 1  # two sets with one key: draw keys anew
        self.shared = self._shared(sketch)
        self.placed = self._across(self._merge(self._place()))

    def _profile(self):
        rows = staged(in_arrow(self.docs, _profiles(self.seed, self.width), "doc_id long, h long, n long, cid long, proof binary, piece int, cells binary"), "join-profile")
        ranks = np.zeros(CELLS, np.uint8)
        summed = in_arrow(rows.where("piece is not null").select("piece", "cells").repartition(partitions(self.spark), "piece"), _sum_cells, "piece int, ranks binary")
        for r in summed.collect():  # CELLS bytes, whatever the input
            ranks[r.piece * PIECE : (r.piece + 1) * PIECE] = np.frombuffer(r.ranks, np.uint8)
        return rows.where("piece is null").select("doc_id", "h", "n", "cid", "proof"), ranks

    def _shared(self, ranks: np.ndarray) -> DataFrame:
        total = self.members.agg(F.sum("n")).first()[0] or 0
        routes = max(4 * partitions(self.spark), total // (1 << 20))
        sent = self.spark.sparkContext.broadcast(ranks)
        blobs = in_arrow(self.docs.select("text"), _routes(sent, self.seed, self.width, routes, self.hot), "route int, hot boolean, pairs binary")
        spread = max(partitions(self.spark), routes // 4)
        out = staged(in_arrow(blobs.repartition(spread, "route", F.when(F.col("hot"), F.crc32("pairs"))), _shared_keys, "key long, cid long"), "join-shared")
        sent.unpersist()
        return out

    def _place(self) -> DataFrame:
        """(cid, rep, n, label, parts, tile, comp) of the classes that share a key. A class's label is the least class it
        shares a key with, followed once more, so that those likely to link lie together; labels of more classes or
        shingles than a tile holds are cut into parts by hash."""
        low = self.shared.groupBy("key").agg(F.min("cid").alias("low"))
        near = staged(self.shared.join(low, "key").groupBy("cid").agg(F.min("low").alias("label")), "join-near")
        far = near.join(near.select(F.col("cid").alias("label"), F.col("label").alias("next")), "label")
        rows = far.select("cid", F.col("next").alias("label")).join(self.classes.select("cid", "rep", "n"), "cid")
        parts = rows.groupBy("label").agg(_parts(self.tile).alias("parts"))
        return staged(rows.join(parts, "label").select("cid", "rep", "n", "label", "parts", _tile("cid", 0).alias("tile"), F.col("cid").alias("comp")), "join-placed")

    def _merge(self, placed: DataFrame) -> DataFrame:
        """Join every tile with itself, then the components' least classes of labels of several parts with each
        other, as long as that shrinks them."""
        placed = self._joined(placed, placed, "join-placed")
        turn, before = 0, None
        while True:
            turn += 1
            heads = placed.where("parts > 1 and cid = comp")
            parts = heads.groupBy("label").agg(F.count("*").alias("m"), _parts(self.tile).alias("now"))
            left = parts.agg(F.sum("m").alias("m"), F.max("now").alias("now")).first()
            if left.m is None or (before is not None and 2 * left.m > before):
                return placed
            before = left.m
            again = heads.drop("parts").join(parts.select("label", F.col("now").alias("parts")), "label").withColumn("tile", _tile("cid", turn))
            placed = self._joined(placed, again, "join-placed")
            if left.now == 1:
                return placed

    def _joined(self, placed: DataFrame, rows: DataFrame, label: str) -> DataFrame:
        links = staged(self._solved(self._sets(rows.select("rep", "cid", "comp", "tile", F.lit(0).alias("side")))), "join-links")
        return staged(placed.join(links, F.col("comp") == F.col("b"), "left").select("cid", "rep", "n", "label", "parts", "tile", F.coalesce("a", "comp").alias("comp")), label)

    def _solved(self, rows: DataFrame) -> DataFrame:
        return in_arrow(rows.repartition(partitions(self.spark), "tile").sortWithinPartitions("tile"), _tiles, "a long, b long")

    def _across(self, placed: DataFrame) -> DataFrame:
        """Join tiles with others that they share a key of several components with. Only the classes that hold such
        a key go along, and two tiles whose holders of it are all of one component need no look."""
        entries = self.shared.join(placed.select("cid", "n", "comp", "tile"), "cid")
        keys = entries.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min("tile").alias("t0"), F.max("tile").alias("t1")).where("c0 <> c1 and t0 <> t1").select("key")
        entries = staged(entries.join(keys, "key"), "join-mixed")
        if not entries.limit(1).count():
            return placed
        tiles = entries.groupBy("key", "tile").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min("n").alias("n0"), F.max("n").alias("n1"))
        most = entries.groupBy("key", "comp").count().groupBy("key").agg(F.max(F.struct("count", "comp")).alias("x")).select("key", F.col("x.comp").alias("main"))
        # Of each two tiles that must meet at a key, one has holders outside the key's main component.
        of = lambda x: [F.struct("tile", "c0", "c1", "n0", "n1").alias(x)]
        odd = tiles.join(most, "key").where("c0 <> main or c1 <> main").select("key", *of("x"))
        meet = odd.join(tiles.select("key", *of("y")), "key").where("x.tile <> y.tile and 4 * x.n1 >= 3 * y.n0 and 4 * y.n1 >= 3 * x.n0 and not (x.c0 = x.c1 and y.c0 = y.c1 and x.c0 = y.c0)")
        meet = meet.select("key", F.least("x", "y").alias("p"), F.greatest("x", "y").alias("q")).distinct().withColumn("pair", F.xxhash64("p.tile", "q.tile"))
        # A key's holders in a tile travel as one row to each tile that theirs meets, so rows don't grow with holders.
        ways = [meet.select("key", F.col(f"{own}.tile").alias("tile"), "pair", F.lit(side).alias("side")) for side, own in enumerate("pq")]
        held = entries.groupBy("key", "tile").agg(F.collect_list(F.struct("cid", "n", "comp")).alias("held"))
        going = held.join(ways[0].unionByName(ways[1]), ["key", "tile"]).select("pair", "side", "key", "held")
        going = going.repartition(partitions(self.spark), "pair").sortWithinPartitions("pair")
        rows = staged(in_arrow(going, _promising, "pair long, side int, cid long, comp long"), "join-across")
        rows = rows.join(placed.select("cid", "rep"), "cid").select("rep", "cid", "comp", F.col("pair").alias("tile"), "side")
        links = self._solved(self._sets(staged(rows, "join-across")))
        comps = components(links).select("id", F.col("comp").alias("to"))
        return placed.join(comps, F.col("comp") == F.col("id"), "left").select("cid", F.coalesce("to", "comp").alias("comp"))

    def _sets(self, wanted: DataFrame) -> DataFrame:
        """``wanted`` (rep, cid and more) with the whole set of each class as column own, from its representative's text."""
        seed, width = self.seed, self.width
        more = [f for f in wanted.schema if f.name != "rep"]
        names = [f.name for f in more]
        ids = wanted.select(F.col("rep.doc_id").alias("r"), F.col("rep.h").alias("h"), *names)
        if wanted.count() * ROW_BYTES <= SEND_BYTES:
            ids = F.broadcast(ids)

        def sets(batches):
            seen = set()
            for batch in batches:
                own = [shingles(t, width) for t in batch.column("text").to_pylist()]
                at = []
                for i, (x, cid, tile) in enumerate(zip(own, batch.column("cid").to_pylist(), batch.column("tile").to_pylist())):
                    if len(x) and class_key(x, seed) == cid and (cid, tile) not in seen:  # else another row of that doc_id, or a repeated one
                        seen.add((cid, tile))
                        at.append(i)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at, pa.int64())) for c in names), pa.array([own[i].tobytes() for i in at], pa.binary())], [*names, "own"])

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in more)
        found = self.docs.alias("d").join(ids.alias("w"), F.expr("d.doc_id <=> w.r and d.h = w.h")).select("text", *names)
        return in_arrow(found, sets, f"{kinds}, own binary")


def _parts(tile: int):
    """Parts that a label's rows (cid, n) fill: by count, and by the bytes of their sets."""
    return F.ceil(F.greatest(F.count("*") / F.lit(tile), F.sum("n") * 8 / F.lit(TILE_BYTES))).cast("int")


def _tile(cid: str, turn: int):
    """Tile id. Tiles or pairs of tiles whose ids happen to be equal are joined as one, which loses nothing."""
    return F.xxhash64(F.lit(turn), "label", F.pmod(F.xxhash64(cid, F.lit(turn)), F.col("parts")))


def shingle_components(docs: DataFrame, width: int = 5, hot: int = HOT, tile: int = TILE) -> DataFrame:
    """Join documents whose sets of ``width``-word shingles have Jaccard similarity of 0.75 or more.

    Returns one row per input row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links).
    Words are split at white space after lower-casing A-Z. A text of fewer words is one shingle; null, empty
    and blank texts have none and are linked with nothing. Repeated rows are documents of one set. A null
    doc_id is never the smallest, unless all of a component are null. An empty table gives no rows; other
    columns are ignored. Shingles are compared by 64-bit hashes. A link inside a component that other links
    already join isn't verified.
    """
    return _components(ShingleJoin(docs, width, hot, tile)).select("doc_id", "n_shingles", "component_id")


def _components(run: ShingleJoin) -> DataFrame:
    """(doc_id, n_shingles, component_id, h, comp) of each row."""
    placed = run.classes.select("cid", "least").join(run.placed.select("cid", "comp"), "cid", "left").select("cid", "least", F.coalesce("comp", "cid").alias("comp"))
    smallest = placed.groupBy("comp").agg(F.min("least").alias("component_id"))
    class_of = placed.join(smallest, "comp").select(F.col("cid").alias("c"), "component_id", "comp")
    component = F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return run.members.join(class_of, F.col("cid") == F.col("c"), "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "h", "comp")


def one_per_component(docs: DataFrame, width: int = 5) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the document of least doc_id stays, whole.

    Rows that share a doc_id stay or go together; rows alike in every column stay once. Texts without words stay.
    Of a component that has only null doc_ids one row stays; null rows of other components go.
    """
    comps = staged(_components(ShingleJoin(docs, width)), "join-components")
    kept = staged(comps.where("doc_id is not null and (n_shingles = 0 or component_id = doc_id)").groupBy(F.col("doc_id").alias("__kept")).agg(F.count("*").alias("__rows")), "join-kept")
    few = kept.count() * 16 <= SEND_BYTES
    ids = lambda some: kept.where(some).select("__kept").hint("broadcast" if few else "merge")
    stay = lambda some: docs.join(ids(some), F.col("doc_id") == F.col("__kept"), "left_semi")
    once = stay("__rows = 1")
    if kept.where("__rows > 1").limit(1).count():
        repeats = Window.partitionBy("doc_id", F.xxhash64(*docs.columns), "text").orderBy(F.lit(1))
        once = once.unionByName(stay("__rows > 1").withColumn("__repeat", F.row_number().over(repeats)).where("__repeat = 1").drop("__repeat"))
    if not comps.where("doc_id is null").limit(1).count():
        return once
    # Rows without doc_id are found by their text's hash; of a component of such rows the least text stays.
    nameless = comps.where("doc_id is null").select("h", "n_shingles", "component_id", "comp").distinct()
    first = nameless.where("n_shingles > 0 and component_id is null").groupBy("comp").agg(F.min("h").alias("__h"))
    blank = docs.where("doc_id is null").withColumn("__h0", F.xxhash64(text_of()))
    empty = nameless.where("n_shingles = 0").select(F.col("h").alias("__h"))
    kept_null = blank.join(first.select("__h"), F.col("__h0") == F.col("__h"), "left_semi").dropDuplicates(["__h0"]).drop("__h0")
    return once.unionByName(kept_null).unionByName(blank.join(empty, F.col("__h0") == F.col("__h"), "left_semi").drop("__h0"))
