"""The corpus operators against brute force, on small tables with nulls, ties, repeats and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from emberlog.llm import lang_id, line_dedup, mixing, packing, quality_rank, quality_rules, shingle_join, toxicity, url_filter
from emberlog.llm.components import components
from emberlog.llm.exact_dedup import exact_dedup
from emberlog.llm.queries import vocabulary

from ..conftest import DATA

#: Columns besides the contract's whose names might clash with inner ones.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, name string, key string, size long, row long, copies int, n int"
UPPER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")

LONG = " ".join(f"word{i % 7919}" for i in range(30000))
TEXTS = [
    (1, "Hello World, this is a line\nhello world, THIS is a line \nshort\nÀÉ other words that are long enough"),
    (2, "hello world, this is a line\nHELLO WORLD, this is a line \nshort\nÀÉ Other words that are long enough"),
    (3, "hello world, this is a line\nhello world, this is a line \nshort\nàé other words that are long enough"),
    (4, None),
    (5, ""),
    (6, " \n\t\x0b "),
    (7, LONG),
    (8, LONG.upper()),
    (9, LONG + " end"),
    (10, "one two three"),
    (11, "One  two\nthree"),
    (11, "One  two\nthree"),
    (12, "same same same same same same"),
    (None, "hello world, this is a line\na line only the nameless row holds"),
    (None, None),
    (13, "a\x1cb\x85c d\u3000e " * 20 + "😀😀"),
]


def table(spark, texts, **more):
    return spark.createDataFrame([(d, t, more.get("lang"), None if d is None or d % 3 == 0 else f"s{d % 3}", 7, "n", "k", 1, 2, 3, 4) for d, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, TEXTS)


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, TEXTS).limit(0)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("block", [4, 64, 4096])
def test_exact_dedup(docs, none, block):
    texts = TEXTS if block > 4 else [x for x in TEXTS if len(x[1] or "") < 1000]
    own = docs if block > 4 else docs.where("text is null or length(text) < 1000")
    out = exact_dedup(own, block)
    groups = defaultdict(list)
    for d, t in texts:
        groups[(t or "").translate(UPPER)].append(d)
    want = [(d, max((x for x in groups[k] if x is not None), default=None), len(groups[k]), sha(k)) for d, t in texts for k in [(t or "").translate(UPPER)]]
    rows = out.collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows), key=str) == sorted(want, key=str)
    kept = Counter(r.text_sha256 for r in rows if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r.doc_id == r.keep_id for r in rows if r.kept)
    assert exact_dedup(none).collect() == []


def brute_lines(texts):
    space = " \t\n\x0b\x0c\r"
    first = {}
    rank = lambda d: 2**63 - 1 if d is None else d
    for d, t in texts:
        for line in (t or "").split("\n"):
            k = line.strip(space).translate(UPPER)
            if len(k) >= 10:
                first[k] = min(first.get(k, 2**63), rank(d))
    out = []
    for d, t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if first.get(x.strip(space).translate(UPPER), 2**63) >= rank(d)]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches, fan_in", [(1, 2), (4, 2), (7, 3)])
def test_line_dedup(docs, none, batches, fan_in):
    out = line_dedup.line_dedup(docs, batches, fan_in)
    assert sorted(((r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in out.collect()), key=str) == brute_lines(TEXTS)
    assert line_dedup.line_dedup(none).collect() == []
    assert line_dedup.line_dedup(docs, carry=["source", "name"]).columns == ["doc_id", "source", "name", "kept_text", "n_lines", "n_dropped"]


def test_line_runs_are_levelled(spark):
    runs = line_dedup.LineRuns(spark, 2)
    for i in range(5):
        runs.add(spark.createDataFrame([(bytes([i]), i), (bytes([0]), i)], "key binary, first long").groupBy("key").agg(F.min("first").alias("first")))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert sorted((r.key[0], r.first) for r in runs.table().collect()) == [(i, i) for i in range(5)]


def test_line_runs_are_read_in_order(spark):
    """A batch's anti-join neither shuffles nor sorts the runs."""
    runs = line_dedup.LineRuns(spark, 3)
    firsts = lambda i: spark.range(i, i + 50).select(F.col("id").cast("string").cast("binary").alias("key"), F.col("id").alias("first")).groupBy("key").agg(F.min("first").alias("first"))
    runs.add(firsts(0))
    runs.add(firsts(100))
    ordering = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    spark.conf.set(ordering, "true")
    try:
        found = firsts(20)
        for run in runs.runs():
            found = found.join(run.hint("merge"), "key", "left_anti")
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(ordering, "false")
    assert plan.count("SortMergeJoin") == 2 and plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1
    assert sorted(int(r.key) for r in found.collect()) == list(range(50, 70))


def brute_counts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {p for i, w in enumerate(windows) if seen[w] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, docs, none):
    rng = random.Random(2)
    texts = TEXTS + [(i, " ".join(rng.choices(["a", "b", "c#", "d"], k=n)) + "\nx\nx\n") for i, n in enumerate([1, 2, 3, 4, 5, 40, 60, 200], 50)]
    out = quality_rules.quality_rules(table(spark, texts))
    have = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out.collect()), key=str)
    want = []
    for d, t in texts:
        n, chars, symbols, dup, repeats = brute_counts(t)
        want.append((d, n, chars, symbols, dup, repeats, n < 50 or 100 * repeats > 50 * n))
    assert have == sorted(want, key=str)
    assert quality_rules.quality_rules(none).collect() == []


def test_bad_host_loses_good_documents(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "too short"
    rows = [(i, good if i % 10 == 0 else bad, "en", "spam" if i < 200 else "fine", 1) for i in range(200)] + [(i, good, "en", "fine", 1) for i in range(200, 400)] + [(500, bad, "en", "new", 1), (501, good, "en", None, 1)]
    out = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert not out[0].kept and not out[0].base_failed
    assert out[250].kept and out[501].kept and not out[500].kept


def test_packing_round_trip(docs, none):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(vocabulary())
    for length, block in ((64, 500), (2048, 1 << 20)):
        rows = packing.pack_documents(docs, vocabulary(), length, block).collect()
        filled = defaultdict(int)
        for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == filled[r.sequence_id] and 0 < r.length == len(r.ids) // 4
            filled[r.sequence_id] += r.length
        assert all(n == length or n & (n - 1) == 0 for n in filled.values())
        want, have = Counter(), Counter()
        for d, t in TEXTS:
            want[d] += len(model.encode(t or "", add_special_tokens=False).ids) + 1
        for r in rows:
            have[r.doc_id] += r.length
        assert have == want
        for d in (1, 7, 13):
            ids = b"".join(r.ids for r in sorted((r for r in rows if r.doc_id == d), key=lambda r: r.start))
            text = dict(TEXTS)[d]
            assert np.frombuffer(ids, "<u4").tolist() == [*model.encode(text, add_special_tokens=False).ids, 1]
            assert zlib.crc32(ids) == docs.sparkSession.range(1).select(F.crc32(F.lit(ids)).alias("c")).first().c
    assert packing.pack_documents(none, vocabulary()).collect() == []


def test_packing_encoder_on_odd_texts():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(vocabulary())
    model.encode_special_tokens = True
    own = packing.ChunkEncoder(vocabulary())
    texts = ["", "  ", " \n", "don't we'll I'm ", "<|endoftext|> a<|endoftext|>", "漢字 ok", "x\u3000 y", "\x1c a \x85b", "word. Word!! 12 3a_b", "ﬁ ǅ ª ᵃ ١٢"]
    texts += ["".join(random.Random(i).choices(" \n\tab.,'s1é漢 _%", k=40)) for i in range(500)]
    for text, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == model.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing_cuts_words_from_marks_and_lines(monkeypatch):
    from tokenizers import Tokenizer

    model, own, calls = Tokenizer.from_file(vocabulary()), packing.ChunkEncoder(vocabulary(), encode_special_tokens=False), []
    monkeypatch.setattr(packing, "CACHE_CHUNKS", 50)
    split = own.split
    own.split = lambda piece: calls.append(piece) or split(piece)
    plain = ["one two, three$$$\nFour five!! six.\nSEVEN (", "Étè##\nTwo &&& ça;\nend"]
    rng = random.Random(8)
    odd = ["".join(rng.choices([" ", " ", "\n", "\t", "\u3000", "\x1c", "a", "be", "É", "7", ".", "$$", "'s", "_", "漢", "e\u0301", "²"], k=rng.randrange(12))) for _ in range(3000)]
    for texts in (plain, *(odd[i : i + 20] for i in range(0, 3000, 20))):
        for text, ids in zip(texts, own.encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == model.encode(text, add_special_tokens=False).ids, repr(text)
        if texts is plain:
            # Words beside marks and line breaks are cut without the vocabulary's costly rule.
            assert {c.strip() for c in calls} <= {"(", "&&&"}


def test_packing_reads_added_tokens(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(vocabulary())
    texts = ["end of it <|endoftext|> next page", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext| >", "plain  text", None]
    rows = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), vocabulary()).collect()
    for d, text in enumerate(texts):
        own = sorted((r for r in rows if r.doc_id == d), key=lambda r: r.start)
        want = [*model.encode(text or "", add_special_tokens=False).ids, 1]
        assert np.frombuffer(b"".join(r.ids for r in own), "<u4").tolist() == want and {r.doc_tokens for r in own} == {len(want)}
    assert 50256 in model.encode(texts[0], add_special_tokens=False).ids


def test_packing_balances_cost():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 900, 3000).tolist()
    cost = defaultdict(float)
    for _, _, n, slot, _ in packing.assign(sizes):
        cost[slot] += n + n * n / 2048
    full = [c for s, c in cost.items() if packing.slots(sum(sizes), 2048)[s] == 2048]
    assert max(full) < 1.35 * min(full)


def brute_targets(sizes):
    """Targets by source for sizes in order."""
    w, total, capped = [i % 3 + 1 for i in range(len(sizes))], sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left, over = total - sum(3 * sizes[i] for i in capped), sum(w[i] for i in range(len(sizes)) if i not in capped)
        new = {i for i in free if left * w[i] / over > 3 * sizes[i]}
        if not new:
            return [3 * sizes[i] if i in capped else left * w[i] / over for i in range(len(sizes))]
        capped |= new


def test_mixing(spark, docs, none):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 30, 300, 4000])), rng.choice(["b", "a", None, "é", "c"] + ["a"] * 5)) for i in range(2000)] + [(9000, "only two", "tiny"), (9001, "x " * 9, "zz"), (9001, "x " * 9, "zz")]
    own = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    out = mixing.mix(own, 100)
    have = got(out.select("doc_id", "size", "source", "source_size", "target", "copies"))
    assert have == got(mixing.mix(own.repartition(7), 100).select("doc_id", "size", "source", "source_size", "target", "copies"))
    sums = Counter()
    for _, t, s in rows:
        sums[s] += len(t.split())
    order = sorted((s for s in sums if s is not None)) + [None]
    targets = dict(zip(order, brute_targets([sums[s] for s in order])))
    assert targets["tiny"] == 6
    taken = Counter()
    for _, size, source, source_size, target, copies in have:
        assert source_size == sums[source] and abs(target - targets[source]) < 1e-6 * (1 + target) and 0 <= copies <= 3
        taken[source] += size * copies
    for s in order:
        assert abs(taken[s] - targets[s]) <= 0.01 * targets[s] + 10, s
    assert mixing.mix(none).collect() == []
    again = mixing.mixed_documents(own, 100)
    assert again.columns == own.columns
    assert sum(r.n for r in again.groupBy("doc_id").agg(F.count("*").alias("n")).collect()) == sum(r[5] for r in have if r[1] or r[5])
    assert mixing.mixed_documents(docs).columns == docs.columns and mixing.mixed_documents(none).count() == 0


def brute_components(texts):
    sets, ids = [], [d for d, _ in texts]
    for _, t in texts:
        w = WORD.findall((t or "").translate(UPPER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    members = defaultdict(list)
    for i, d in enumerate(ids):
        members[find(i)].append(d)
    least = {r: min((d for d in m if d is not None), default=None) for r, m in members.items()}
    return sorted(((d, len(s), least[find(i)] if s else d) for i, (d, s) in enumerate(zip(ids, sets))), key=str)


def near_copies(seed=5):
    rng = random.Random(seed)
    texts, passage = list(TEXTS), [f"p{i}" for i in range(40)]
    for group in range(6):
        base = [f"g{group}w{rng.randrange(400)}" for _ in range(rng.choice([6, 20, 80, 200]))]
        for _ in range(rng.choice([2, 12, 40])):
            words = [w if rng.random() > rng.choice([0.0, 0.01, 0.04, 0.08]) else "new" + str(rng.random()) for w in base]
            texts.append((len(texts) + 100, " ".join(words)))
    for i in range(30):
        texts.append((len(texts) + 100, " ".join([*passage, *(f"u{i}x{k}" for k in range(rng.choice([2, 10, 16, 60])))])))
    return texts


@pytest.mark.parametrize("hot, tile", [(shingle_join.HOT, shingle_join.TILE), (8, 4), (1, 2)])
def test_shingle_components(spark, hot, tile):
    texts = near_copies()
    run = shingle_join.shingle_components(table(spark, texts), hot=hot, tile=tile)
    assert got(run) == [(d, n, c) for d, n, c in brute_components(texts)]


def test_shingle_links_grow_linearly(spark):
    """A group of m near copies, most of which link with each other, sends out about m links, whatever its size."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(300)}" for _ in range(120)]
    for m in (60, 240):
        texts = [(i, " ".join(w if rng.random() > 0.01 else f"x{rng.random()}" for w in base)) for i in range(m)]
        run = shingle_join.ShingleJoin(table(spark, texts), tile=16)
        rows = run._place()
        links = run._solved(run._sets(rows.select("rep", "cid", "comp", "tile", F.lit(0).alias("side")))).count()
        assert 0.5 * m < links < m and run.placed.select("comp").distinct().count() <= 0.1 * m


def test_tile_verifies_what_the_bound_lets_through():
    rng = np.random.default_rng(1)
    base = np.sort(rng.choice(1 << 40, 80, False)).astype(np.uint64) << np.uint64(20)
    own = [np.sort(np.concatenate([base[:keep], rng.integers(1 << 62, 1 << 63, 80 - keep).astype(np.uint64)])) for keep in (80, 79, 69, 68, 40)]
    cid = np.arange(5)
    old, new = shingle_join.join_tile(cid, cid, np.zeros(5, int), own)
    assert old.tolist() == [0, 1, 2, 3, 4] and new.tolist() == [0, 0, 0, 3, 4]  # 69 of 91 link, 68 of 92 don't
    across = shingle_join.join_tile(cid, np.array([0, 1, 1, 3, 4]), np.array([0, 0, 1, 1, 1]), own)[1]
    assert across.tolist() == [0, 0, 3, 4]


def test_shingle_join_odd_tables(spark, docs, none):
    assert shingle_join.shingle_components(none).collect() == []
    assert got(shingle_join.shingle_components(docs)) == brute_components(TEXTS)
    stay = shingle_join.one_per_component(docs)
    assert stay.columns == docs.columns
    assert sorted((r.doc_id for r in stay.collect()), key=str) == sorted([1, 3, 4, 5, 6, 7, 10, 12, 13, None, None], key=str)
    words = " ".join(f"n{i}" for i in range(50))
    nameless = table(spark, [(None, words), (None, words), (None, words + " more"), (None, LONG), (None, ""), (20, "x " * 9), (20, "x " * 9)])
    left = sorted((str(r.doc_id), len(r.text or "")) for r in shingle_join.one_per_component(nameless.union(docs)).collect())
    assert [x for x in left if x[0] == "20"] == [("20", 18)]
    assert len([n for d, n in left if d == "None" and n in (len(words), len(words) + 5)]) == 1 and ("None", len(LONG)) not in left


def test_rtree_finds_every_pair():
    rng = np.random.default_rng(0)
    for size in (1, 2, 16, 17, 300):
        vec = rng.poisson(rng.choice([0.3, 2.0], (size, 1)), (size, 512)).astype(np.int32)
        n, comp = vec.sum(1), rng.integers(0, max(1, size // 3), size)
        tree = shingle_join.RTree(vec, n, comp)
        found = {(min(a, b), max(a, b)) for i, j in tree.join(tree) for a, b in zip(i.tolist(), j.tolist())}
        want = {(i, j) for j in range(size) for i in range(j) if comp[i] != comp[j] and 7 * np.minimum(vec[i], vec[j]).sum() >= 3 * (n[i] + n[j])}
        assert found == want


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)] + [(-5, 400), (400, 401), (7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    have = {r.id: r.comp for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    for x in {v for e in links if e[0] != e[1] for v in e}:
        assert have[x] == min(y for y in list(root) if find(y) == find(x))
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_language_id(spark, docs, none):
    corpus = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    model = lang_id.train(corpus, per_lang=150)
    assert model.langs == ["de", "en", "es", "fr"]
    out = lang_id.identify(corpus, model, ["doc_id", "lang"]).toPandas()
    rest = out[[held_out(d) for d in out.doc_id]]
    assert (rest.lang == rest.lang_pred).mean() > 0.98 and (~out.rejected).mean() > 0.98
    odd = {r.doc_id: r for r in lang_id.identify(docs, model, ["doc_id"]).collect()}
    assert all(odd[d].lang_pred == "und" and odd[d].rejected and odd[d].score == 0 for d in (4, 5, 6))
    assert len(docs.collect()) == lang_id.identify(docs, model).count()
    assert lang_id.identify(none, model, ["doc_id"]).collect() == []
    assert {r.lang_pred for r in lang_id.identify(docs, lang_id.train(none)).collect()} == {"und"}


def test_kneser_ney_probabilities_sum_to_one():
    texts = {"x": "abracadabra abba", "y": "bobo bada"}
    counts = {k: np.unique(lang_id.grams(lang_id.codes(t)), return_counts=True) for k, t in texts.items()}
    model = lang_id.estimate(counts)
    letters = sorted({int(c) for t in texts.values() for c in lang_id.codes(t)[3:]})
    for context in ("abr", "zzz", "a b", "bob"):
        before = [ord(c) for c in context]
        keys = np.array([before[0] << 48 | before[1] << 32 | before[2] << 16 | w for w in letters], np.uint64)
        unseen = np.array([before[0] << 48 | before[1] << 32 | before[2] << 16 | 0x2603], np.uint64)
        total = np.exp(model.score(keys).astype(float)).sum(0) + np.exp(model.score(unseen).astype(float))[0]
        assert np.allclose(total, 1, atol=1e-4), (context, total)


def auc(score, label):
    rank = score.rank()
    pos = label == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.mark.parametrize("operator, label, least, size", [(quality_rank.rank_quality, "quality", 0.9, "sf0.01"), (toxicity.score_toxicity, "toxic", 0.95, "sf0.1")])
def test_classifiers(spark, docs, none, operator, label, least, size):
    corpus, labels = (spark.read.parquet(f"{DATA}/{size}/{t}.parquet") for t in ("documents", "labels"))
    out = operator(corpus, labels).toPandas()
    assert [held_out(d) for d in out.doc_id] == out.held_out.tolist() and out.score.between(0, 1).all()
    rest = out[out.held_out].merge(labels.toPandas(), on="doc_id")
    assert auc(rest.score, rest[label]) > least
    assert (rest.predicted == rest[label]).mean() > 0.85
    if label == "toxic":
        assert rest[rest.toxic == 1].predicted.mean() > 0.85 and rest[rest.toxic == 0].predicted.mean() < 0.05
    no_labels = labels.limit(0)
    assert len({r.score for r in operator(docs, no_labels).collect()}) == 1
    odd = spark.createDataFrame([(1, 1, None), (1, 0, 1), (None, 1, 1), (3, None, 0), (2, 0, 0), (7, 1, 1)], "doc_id long, quality int, toxic int").withColumn("score", F.lit(9))
    scores = Counter((r.doc_id, r.score) for r in operator(docs, odd).collect())
    assert sum(scores.values()) == len(TEXTS) and all(0 <= x <= 1 for _, x in scores) and scores.most_common(1)[0][1] >= 2
    assert len({x for d, x in scores if d in (4, 5)}) == 1  # null is empty; so is a text of nothing
    assert operator(none, labels).collect() == []


def test_quality_learns_from_every_labelled_row(spark):
    rng = random.Random(5)
    rows = [(i, " ".join("".join(rng.choices("abcdefgh,.", k=rng.randrange(1, 12))) for _ in range(rng.randrange(3, 9))), int(rng.random() < 0.4)) for i in range(14000)]
    table_ = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    out = quality_rank.rank_quality(table_.drop("quality"), table_.drop("text")).toPandas()
    first = [zlib.crc32(str(d).encode()) % 5 == 1 for d in out.doc_id]
    labels_ = {d: q for d, _, q in rows}
    # All of the fold that sets the threshold counts: as many are predicted as are labelled.
    assert abs(out.predicted[first].sum() - sum(labels_[d] for d in out.doc_id[first])) <= 3


def test_quality_fit_equals_brute_force_over_all_pairs(spark):
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(400, quality_rank.FEATURES)) * 10.0 ** rng.integers(-3, 4, quality_rank.FEATURES)).astype("<f4")
    x[:, 3], x[:, 5] = np.round(x[:, 3]), 0
    fold, label = np.arange(400) % 4 + 1, (x[:, 0] / x[:, 0].std() + rng.normal(size=400) > 0).astype(int)
    rows = spark.createDataFrame([(int(f), int(y), r.tobytes()) for f, y, r in zip(fold, label, x)], "fold int, label int, x binary").repartition(5).cache()
    model = quality_rank.fit(rows)
    learn, held = fold != 1, fold == 1
    edges = np.quantile(x[learn], np.linspace(0, 1, 13)[1:-1], axis=0, method="higher").T
    assert np.array_equal(model.edges, edges)
    z, (good, bad) = quality_rank.expand(x.astype(float), edges), (np.flatnonzero(learn & (label == y)) for y in (1, 0))
    difference, weights = (z[good][:, None] - z[bad]).reshape(-1, z.shape[1]), np.zeros(z.shape[1])
    unit = 6 * max(len(good), len(bad)) / len(difference)
    for _ in range(30):
        p = 1 / (1 + np.exp(difference @ weights))
        curve = unit * (difference * (p * (1 - p))[:, None]).T @ difference + 2 * np.eye(len(weights))
        weights += np.linalg.solve(curve, unit * difference.T @ p - 2 * weights)
    assert np.abs(model.weights - weights).max() < 0.01
    raw = z[held] @ model.weights
    assert (raw >= model.threshold).sum() == label[held].sum() and np.isclose(model.scale, raw.std() / 2, atol=1e-4)
    assert np.array_equal(quality_rank.fit(rows.repartition(3)).weights, model.weights)


def test_boosting_and_isotonic():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = toxicity.TreeModel({}, *toxicity.boost(x, y), np.zeros(1), np.zeros(1))
    assert ((model.sums(x) > 0) == (y == 1)).mean() > 0.97
    knots, values = toxicity.isotonic(np.array([1.0, 2, 2, 3, 4]), np.array([0.0, 1, 0, 0, 1]))
    assert (np.diff(values) >= 0).all() and np.allclose(np.interp([1, 2, 3, 4], knots, values), [0, 1 / 3, 1 / 3, 1])


def test_url_rules(spark):
    urls = {
        "http://Example.ORG/es/1": ("example.org", "/es/1", "example.org/es/", "block"),
        "https://a.example.org/en/12?x": ("a.example.org", "/en/12", "example.org/en/1", "block"),
        "https://a.example.org/en/2#t": ("a.example.org", "/en/2", "org/", "allow"),
        "http://x.com/fr/": ("x.com", "/fr/", "com/fr/", "allow"),
        "http://x.com/fr": ("x.com", "/fr", None, "allow"),
        "http://com/de/9": ("com", "/de/9", "com/de/", "block"),
        "http://org": ("org", "", None, "allow"),
        "http://borg.net/": ("borg.net", "/", None, "allow"),
        "no scheme org/": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "http://é.ORG/ü?q://z": ("é.org", "/ü", "org/", "allow"),
    }
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)] + [(0, "http://Example.ORG/es/1", "x", "y")], "page_id long, url string, host string, verdict string")
    labels = spark.createDataFrame([(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    rows = url_filter.filter_urls(pages, labels).collect()
    assert sorted(((r.host, r.path, r.rule, r.verdict) for r in rows), key=str) == sorted([*urls.values(), urls["http://Example.ORG/es/1"]], key=str)
    assert url_filter.filter_urls(pages.limit(0), labels).collect() == []


def test_url_mining_finds_planted_combinations(spark):
    rng = random.Random(3)
    pages, labels = [], []
    for i in range(1500):
        ads, promo = rng.random() < 0.3, rng.random() < 0.3
        pages.append((i, f"https://{'ads' if ads else 'www'}.site{rng.randrange(5)}.net/{'promo' if promo else 'news'}/{i}"))
        if i % 2:
            labels.append((i, 0 if ads and promo else 1, 0))
    out = url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    for r in out:
        assert r.verdict == ("block" if r.host.startswith("ads") and r.path.startswith("/promo") else "allow")
    rules = url_filter.RuleIndex([(frozenset({"a", "b"}), "block", 0.9, 0.1), (frozenset({"a"}), "allow", 0.8, 0.5)])
    assert rules.match(["a", "b"]) == 0 and rules.match(["a"]) == 1 and rules.match(["b"]) is None


def brute_rules(rows, enough, confidence):
    """Rules (tokens, verdict, confidence) of all token sets of (url, verdict) rows, then those that no part of equal confidence makes needless."""
    counts = defaultdict(Counter)
    for url, verdict in rows:
        own = url_filter.tokens(url)
        for k in range(1, len(own) + 1):
            for s in combinations(own, k):
                counts[s][verdict] += 1
    raw = {(frozenset(s), v): n / c.total() for s, c in counts.items() for v, n in c.items() if n >= enough and n / c.total() >= confidence}
    parts = lambda s: (frozenset(p) for k in range(1, len(s)) for p in combinations(s, k))
    return {(s, v, x) for (s, v), x in raw.items() if not any(raw.get((p, v), 0) >= x for p in parts(s))}


def test_url_mining_same_as_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(300):
        ads, promo, keys = rng.random() < 0.5, rng.random() < 0.5, [k for k in "xy" if rng.random() < 0.7]
        url = f"https://{'ads' if ads else 'www'}.site{rng.randrange(2)}.net/{'promo' if promo else 'news'}?{'&'.join(keys)}"
        rows.append((url, "block" if rng.random() < 0.1 + 0.3 * ads + 0.3 * promo * len(keys) else "allow"))
    have = url_filter.mine(spark.createDataFrame(rows, "url string, verdict string"))
    want = brute_rules(rows, 20, 0.6)
    assert len(want) > 20 and {r[:3] for r in have} == want and len(have) == len(want)
    sure = max(want, key=lambda r: r[2])
    assert url_filter.RuleIndex(have).rules[0][2] == sure[2]


def test_url_mining_reaches_long_combinations(spark):
    # Sixteen hosts of four parts, so over 10,000 raw rules are shorter than the one of all five keys.
    rng = random.Random(9)
    rows = []
    for i in range(800):
        h, keys = i % 16, [k for k in "vwxyz" if rng.random() < 0.9]
        rows.append((f"http://h{h}.a{h}.b{h}.net/p{h}?{'&'.join(keys)}", "block" if len(keys) == 5 else "allow"))
    rules = {(s, v): x for s, v, x, _ in url_filter.mine(spark.createDataFrame(rows, "url string, verdict string"))}
    assert rules[frozenset("key=" + k for k in "vwxyz"), "block"] == 1.0


def test_words_kept_by_a_worker_are_bounded():
    """Also by a task's function as workers get it, whose globals are copies."""
    run = cloudpickle.loads(cloudpickle.dumps(shingle_join._profiles(0, 5)))
    texts = [" ".join(f"w{k}x{i}" for i in range(20_000)) for k in range(6)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(6), pa.int64()), "h": pa.array(range(6), pa.int64()), "text": texts})
    sizes = [n for out in run(iter([batch])) for n in out.column("n").to_pylist() if n is not None]
    assert sizes == [19_996] * 6
    assert len(shingle_join._WORDS) <= shingle_join.KEEP_WORDS


def test_classes_go_across_tiles_if_they_share_keys_enough():
    draw = np.random.default_rng(5)
    for _ in range(20):
        classes = [(i, int(draw.integers(20, 60)), int(draw.integers(0, 12)), set(draw.integers(0, 6000, draw.integers(1, 14)).tolist()) | set(draw.integers(0, 9, 6).tolist())) for i in range(40)]
        rows = [(k, i % 2, i, n, comp) for i, n, comp, keys in classes for k in keys]
        draw.shuffle(rows)
        want = [set(), set()]
        for i, n, comp, keys in classes[::2]:
            for j, m, other, theirs in classes[1::2]:
                least = max(1, 3 * (n + m) / 7 - 3 * max(n, m) / 4 - 1e-6)
                if comp != other and 4 * n >= 3 * m and 4 * m >= 3 * n and len(keys & theirs) >= least:
                    want[0].add(i), want[1].add(j)
        got = shingle_join.promising(*(np.array(x) for x in zip(*rows)))
        assert [set(cids.tolist()) for cids, _ in got] == want
        assert all(classes[c][2] == comp for cids, comps in got for c, comp in zip(cids.tolist(), comps.tolist()))
