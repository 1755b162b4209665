import json
import struct

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from emberlog.engine import LogStore
from emberlog.functions.text import fnv1a32, folded, shard_of, tokenize
from emberlog.operators import cluster, index, ingest, maintenance
from emberlog.operators.cache import PageCache
from emberlog.operators.merge import federated
from emberlog.operators.ingest import with_stable_ids
from emberlog.operators.search import InvalidQuery, LogQuery, QueryResult, first_by_id, newest_first
from emberlog.plans.language import QuerySyntaxError, parse
from emberlog.schema import COLUMNS, DAY_NS, derived, normalise
from emberlog.sources import segments
from emberlog.streaming.ingest import file_stream, ingest_stream, nullable_schema

SCHEMA = "id string, namespace string, service string, level string, message string, timestamp_ns long, fields map<string,string>"


def make(spark, *rows):
    """Rows of (id, namespace, service, level, message, timestamp[, fields])."""
    return spark.createDataFrame([(*r, {})[:7] for r in rows], SCHEMA)


@pytest.fixture
def engine(spark, tmp_path):
    return LogStore(spark, str(tmp_path / "logs"))


def ids(result):
    return [e.id for e in result.entries]


def test_basic_search(spark, engine):
    assert engine.search(LogQuery()).total == 0
    engine.ingest_batch(make(spark, ("1", "", "dispatch", "INFO", "parcel left depot", 100), ("2", "", "db", "ERROR", "scale drift noted", 200), ("3", "", "dispatch", "WARN", "Parcel Went astray", 300)))
    assert ids(engine.search(LogQuery("parcel"))) == ["3", "1"]
    assert ids(engine.search(LogQuery("log"))) == []
    assert ids(engine.search(LogQuery(service="db"))) == ["2"]
    assert ids(engine.search(LogQuery(start_ns=150, end_ns=300))) == ["3", "2"]
    assert ids(engine.search(LogQuery("parcel", service="dispatch", start_ns=200, end_ns=400))) == ["3"]
    assert ids(engine.search(LogQuery("level:error OR level:warn"))) == ["3", "2"]


def test_page_order_and_total(spark, engine):
    engine.ingest_batch(make(spark, *[(x, "", "svc", "", "alpha", t) for x, t in zip("cabde", (100, 100, 100, 300, 0))]))
    all_ = engine.search(LogQuery("alpha"))
    assert (ids(all_), all_.total) == (["d", "a", "b", "c", "e"], 5)
    part = engine.search(LogQuery("alpha", limit=2, offset=1))
    assert (ids(part), part.total, part.partial) == (["a", "b"], 5, False)
    past = engine.search(LogQuery("alpha", offset=10))
    assert (ids(past), past.total) == ([], 5)
    none = engine.search(LogQuery("beta"))
    assert (ids(none), none.total) == ([], 0)
    for bad in (LogQuery(limit=-1), LogQuery(offset=-1), LogQuery(limit=2**31 - 1, offset=1)):
        with pytest.raises(InvalidQuery):
            engine.search(bad)
    assert LogQuery().checked().limit == 100


def test_fields_namespaces_and_missing_keys(spark, engine):
    engine.ingest_batch(make(spark, ("1", "team-alpha", "s", "x", "m", 1, {"Host": "h1"}), ("2", "team-beta", "s", "x", "m", 1, {"Host": ""}), ("3", "", "s", "x", "m", 1)))
    assert ids(engine.search(LogQuery("Host:h1"))) == ["1"]
    assert ids(engine.search(LogQuery("host:h1"))) == []
    assert ids(engine.search(LogQuery("Host:"))) == ["2", "3"]
    assert ids(engine.search(LogQuery("namespace:"))) == ["3"]
    assert ids(engine.search(LogQuery("NameSpace:team-beta"))) == ["2"]
    assert ids(engine.search(LogQuery(namespace="team-beta", service="s"))) == ["2"]
    assert len(engine.search(LogQuery()).entries) == 3


def test_ingest_validates_stamps_and_drops_known_ids(spark, engine):
    batch = make(spark, ("1", "", "s", "", "m", 5), ("2", "", "", "", "m", 5), ("3", None, "s", None, "m", 0, None), (None, "", "s", "", "", 1), ("1", "", "s", "", "m", 5))
    assert engine.ingest_batch(batch) == {"accepted": 3, "rejected": 2}
    stored = {r.id: r for r in engine.table().collect()}
    assert sorted(stored) == ["1", "3"]
    assert stored["3"].namespace == "" and stored["3"].fields == {} and stored["1"].received_at_ns > 10**18
    engine.ingest_batch(batch)
    assert engine.table().count() == 2
    auto = engine.ingest(service="s", message="single")
    assert auto.startswith("auto-") and len(auto) == 21
    for bad in ({"service": "s"}, {"message": "m"}, {}):
        with pytest.raises(ValueError):
            engine.ingest(**bad)
    assert ids(engine.search(LogQuery("single"))) == [auto]


def test_cached_pages_end_with_ingest(spark, engine):
    engine.ingest_batch(make(spark, ("1", "", "s", "", "m", 5)))
    first = engine.search(LogQuery("m"))
    assert engine.search(LogQuery("m")) is first
    engine.ingest_batch(make(spark, ("2", "", "s", "", "m", 5)))
    assert ids(engine.search(LogQuery("m"))) == ["1", "2"]


def test_page_cache():
    now = [0.0]
    cache = PageCache(2, 30, lambda: now[0])
    r = lambda partial=False: QueryResult([], 0, 0, partial)
    cache.put("p", r(True))
    assert cache.get("p") is None
    cache.put("a", r()), cache.put("b", r())
    assert cache.get("a")
    cache.put("c", r())
    assert cache.get("b") is None and cache.get("a") and len(cache) == 2
    now[0] = 30
    assert cache.get("a") is None


def test_hash_vectors_and_tokens(spark):
    words = spark.createDataFrame([("a", 0xE40C292C), ("foobar", 0xBF9CF968), (":svc", 0xDB97BD45), ("ns1:api", 0xC903093F), ("é", 0x1E9DE8C1), ("", 2166136261)], "w string, h long")
    assert [r.got for r in words.select(fnv1a32("w").alias("got"), "h").where("got <> h").collect()] == []
    row = spark.range(1).select(tokenize(F.lit("İstanbul Foo-bar foo über 9")).alias("t"), folded(F.lit("ERROſ")).alias("f"), shard_of(F.lit("n"), F.lit("s"), 0).alias("z")).first()
    assert (row.t, row.f, row.z) == (["istanbul", "foo", "bar", "ber", "9"], "erros", 0)


def test_federated_search(spark):
    stored = lambda *r: derived(normalise(make(spark, *r)))
    one = lambda: stored(("shared", "", "s", "", "m", 200), ("e1", "", "s", "", "m", 100))
    two = lambda: stored(("shared", "", "s", "", "m", 200), ("e2", "", "s", "", "m", 300))

    def broken():
        return spark.read.parquet("/nowhere/at/all")

    both = federated({"n1": one, "n2": two}, LogQuery("m"), COLUMNS)
    assert (ids(both), both.total, both.partial) == (["e2", "shared", "e1"], 3, False)
    assert ids(federated({"n1": one, "n2": two}, LogQuery("m", limit=1, offset=1), COLUMNS)) == ["shared"]
    some = federated({"n1": one, "n2": broken}, LogQuery("m"), COLUMNS, allow_partial=True)
    assert (ids(some), some.partial, some.failed) == (["shared", "e1"], True, ["n2"])
    nothing = federated({"n2": broken}, LogQuery("m"), COLUMNS, allow_partial=True)
    assert (nothing.entries, nothing.total, nothing.partial) == ([], 0, True)
    with pytest.raises(Exception):
        federated({"n1": one, "n2": broken}, LogQuery("m"), COLUMNS)
    with pytest.raises(QuerySyntaxError):
        federated({"n2": broken}, LogQuery("a b"), COLUMNS, allow_partial=True)


def test_index_and_blooms_change_no_result(spark):
    logs = derived(normalise(make(spark, ("1", "", "s1", "ERROR", "pump seal worn", 100, {"k": "v"}), ("2", "n", "s2", "INFO", "pump primed", 500), ("3", "", "s1", "INFO", "seal primed", 900))))
    logs = logs.withColumn("segment", F.concat(F.lit("/seg/"), F.col("id"))).cache()
    args = index.postings(logs), index.label_postings(logs), index.zone_map(logs)
    found = lambda *a, **k: sorted(r.segment for r in index.resolve(*args, *a, **k).collect())
    assert found(["seal"]) == ["/seg/1", "/seg/3"]
    assert found(["seal", "primed"]) == ["/seg/3"]
    assert found(["nope"]) == []
    assert found(start_ns=300, end_ns=600) == ["/seg/2"]
    assert found(service="s1") == ["/seg/1", "/seg/3"]
    assert found(namespace="n") == ["/seg/2"]
    assert found() == ["/seg/1", "/seg/2", "/seg/3"]
    assert index.token_count(args[0]).first().tokens == 4
    left = index.without_segments(args[0], spark.createDataFrame([("/seg/1",)], "segment string"))
    assert sorted(r.token for r in left.select("token").distinct().collect()) == ["primed", "pump", "seal"]
    blooms = index.SegmentBlooms.build(logs)
    for text, must in (("seal", {"/seg/1", "/seg/3"}), ("k:v", {"/seg/1"}), ("level:error", {"/seg/1"}), ("service:s2 AND primed", {"/seg/2"}), ("k:", {"/seg/1", "/seg/2", "/seg/3"}), ("zzz OR seal", {"/seg/1", "/seg/3"})):
        assert must <= set(blooms.candidates(parse(text))), text
    assert blooms.candidates(parse("seal AND qqqqqq")) == []
    logs.unpersist()


def test_maintenance(spark):
    table = lambda *r: spark.createDataFrame(r, "segment string, bytes long")
    runs = {r.segment: r.run for r in maintenance.merge_runs(table(("a", 1), ("b", 2), ("c", 99), ("d", 1), ("e", 100), ("f", 3), ("g", 4), ("h", 5)), 50).collect()}
    assert runs == {"a": "a", "b": "a", "f": "f", "g": "f", "h": "f"}
    assert maintenance.merge_runs(table(("a", 1), ("b", 1)), 0).count() == 0
    zones = spark.createDataFrame([("old", 1, 10), ("zero", 0, 0), ("fresh", 1, 20 * DAY_NS)], "segment string, min_ns long, max_ns long")
    assert [r.segment for r in maintenance.expired(zones, 21 * DAY_NS).collect()] == ["old"]
    assert maintenance.expired(zones, 21 * DAY_NS, 0).count() == 0


def test_retention_and_compaction_of_the_table(spark, engine, tmp_path):
    for i, t in enumerate((1, 2, 30 * DAY_NS, 0)):
        engine.ingest_batch(make(spark, (str(i), "", "s", "", "m", t)))
    smaller = engine.compact(str(tmp_path / "compacted"))
    assert smaller.table().count() == 4
    assert smaller.segments().select("segment").distinct().count() < engine.segments().select("segment").distinct().count()
    assert engine.retain(31 * DAY_NS, 0) == 0
    assert engine.retain(31 * DAY_NS) == 1
    assert [r.id for r in engine.table().collect()] == ["2"]


def test_catch_up_takes_ties_at_the_mark(spark):
    rows = [Row(id=i, received_at_ns=t, shard_id=s) for i, t, s in (("A", 5, 1), ("B", 5, 1), ("C", 4, 1), ("D", 1, 2))]
    primary = spark.createDataFrame(rows)
    replica = spark.createDataFrame(rows[:1])
    assert sorted(r.id for r in ingest.catch_up(primary, replica).collect()) == ["B", "D"]
    assert [r.id for r in ingest.fetch_since(primary, 1, 5).collect()] == ["A", "B"]


def test_assignment(spark):
    nodes = lambda *names: spark.createDataFrame([(n, h) for n, h in names], "node_id string, healthy boolean")
    got = lambda n: [(r.shard_id, r.primary, r.replica) for r in cluster.assign(spark, n, 4).orderBy("shard_id").collect()]
    assert got(nodes(("a", True))) == [(i, "a", None) for i in range(4)]
    assert got(nodes(("b", True), ("a", True))) == [(0, "a", "b"), (1, "b", "a"), (2, "a", "b"), (3, "b", "a")]
    assert got(nodes(("a", False), ("b", True))) == [(i, "b", None) for i in range(4)]
    assert got(nodes(("a", False))) == [(i, None, None) for i in range(4)]
    assert cluster.status(cluster.assign(spark, nodes(("a", True), ("b", True)), 4)).count() == 2


def test_dedup_order(spark):
    rows = spark.createDataFrame([("x", "b", 1, 5), ("x", "a", 2, 7), ("y", "a", 1, 5)], "id string, segment string, pos int, timestamp_ns long")
    assert {(r.id, r.timestamp_ns) for r in first_by_id(rows, "segment", "pos").collect()} == {("x", 7), ("y", 5)}
    assert [r.id for r in newest_first(rows).collect()] == ["x", "x", "y"]


def test_segment_files(spark, tmp_path):
    folder = str(tmp_path / "seg")
    rows = normalise(make(spark, ("1", "n", "s", "I", "héllo wörld", -5, {"k": "v", "": "e"}), ("2", "", "s", "", "x" * 300, 2**62))).coalesce(1)
    segments.write_segments(rows, folder, 100)
    back = segments.read_segments(spark, folder)
    assert sorted(map(str, back.select(COLUMNS).collect())) == sorted(map(str, rows.collect()))
    assert back.select("segment").distinct().count() == 2
    empty = tmp_path / "seg" / f"{9:020d}.seg"
    empty.write_bytes(b"")
    assert segments.read_segments(spark, folder).count() == 2
    for bad in (struct.pack(">I", 10) + b"abc", b"\0\0", struct.pack(">I", 1 << 30), segments.framed(b"\x0a\xff")):
        empty.write_bytes(bad)
        with pytest.raises(Exception):
            segments.read_segments(spark, str(empty)).collect()
    assert segments.checked_name(f"{1:020d}.seg")
    for name in ("../x.seg", "1.seg", f"{1:020d}.bloom"):
        with pytest.raises(ValueError):
            segments.checked_name(name)
    stored = derived(rows).withColumn("segment", F.lit("a"))
    shard = stored.where("id = '1'").first().shard_id
    assert segments.export_segment(stored, "a", shard, str(tmp_path / "out")) == 1
    with pytest.raises(ValueError):
        segments.export_segment(stored, "b", shard, str(tmp_path / "out"))


def test_streaming_ingest_keeps_zero_timestamps_and_drops_replays(spark, engine, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    row = lambda i, t: json.dumps({"id": str(i), "service": "s", "message": "m", "timestamp_ns": t})
    (source / "a.json").write_text("\n".join([row(1, 10**18), row(2, 0), row(2, 0), json.dumps({"id": "bad"})]))
    for extra in ("", "b.json"):
        if extra:
            (source / extra).write_text("\n".join([row(1, 10**18), row(3, 5)]))
        ingest_stream(file_stream(spark, str(source)), engine, str(tmp_path / "ck")).awaitTermination()
    assert sorted((r.id, r.timestamp_ns) for r in engine.table().collect()) == [("1", 10**18), ("2", 0), ("3", 5)]
    assert nullable_schema().fieldNames() == COLUMNS


def test_days_are_cut_in_whole_nanoseconds(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "days"))
    at = [20000 * DAY_NS - 1, 20000 * DAY_NS, 1, -1, -DAY_NS, -DAY_NS - 1]
    store.ingest_batch(make(spark, *((str(i), "", "svc", "INFO", "tick", ns) for i, ns in enumerate(at))))
    days = {r.id: (r.event_date - __import__("datetime").date(1970, 1, 1)).days for r in store.table().select("id", "event_date").collect()}
    assert [days[str(i)] for i in range(len(at))] == [ns // DAY_NS for ns in at]
    assert ids(store.search(LogQuery("tick", end_ns=at[0]))) == ["0", "2", "3", "4", "5"]
    assert ids(store.search(LogQuery("tick", start_ns=at[0], end_ns=at[0]))) == ["0"]
    assert ids(store.search(LogQuery("tick", start_ns=at[1]))) == ["1"]


def test_segments_are_added_never_overwritten(spark, tmp_path):
    folder = str(tmp_path / "more")
    for name in ("first", "second"):
        segments.write_segments(normalise(make(spark, (name, "", "svc", "INFO", name, 1))), folder)
    (tmp_path / "more" / "_attempt-lost").mkdir()
    (tmp_path / "more" / "_attempt-lost" / "0").write_bytes(b"cut off")
    back = segments.read_segments(spark, folder).collect()
    assert sorted(r.id for r in back) == ["first", "second"] and len({r.segment for r in back}) == 2


def test_a_batch_that_comes_again_adds_nothing(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "again"))
    rows = make(spark, ("", "", "svc", "INFO", "no id", 1), ("", "", "svc", "INFO", "no id", 1), ("own", "", "svc", "INFO", "id", 1))
    for batch in ("b/0", "b/0", "b/1"):
        store.ingest_batch(with_stable_ids(rows, batch))
    assert store.table().count() == 5
