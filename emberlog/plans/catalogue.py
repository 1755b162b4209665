"""The registered queries over the driver's tables, each with DuckDB SQL of the same meaning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import all_tokens
from ..plans.language import parse, required_tokens
from ..operators import cluster, index, ingest, maintenance
from ..operators.merge import merged
from ..operators.search import LogQuery, first_by_id, matching, page
from ..schema import DEFAULT_SHARDS
from ..sources.segments import shard_segments
from ..sources.views import doc_logs, logs, raw_logs
from ..streaming.ingest import rates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SHOWN = ["id", "timestamp_ns", "namespace", "service", "level"]
JAN = {day: 1_704_067_200_000_000_000 + (day - 1) * 86_400_000_000_000 for day in range(1, 31)}

#: SQL of the views ``logs`` and ``doclogs``.
HASH = "list_reduce(list_prepend(2166136261::bigint, list_transform(generate_series(1, octet_length(encode(s))::bigint), lambda i: ('0x' || substr(hex(encode(s)), (2*i-1)::int, 2))::bigint)), lambda h, b: (xor(h, b) * 16777619) & 4294967295)"
TOKENS = "list_filter(string_split_regex(lower(message), '[^a-z0-9]+'), lambda x: x <> '')"
LOGS = f"""
with raw_logs as (
  select 'evt-' || lpad(event_id::varchar, 10, '0') as id, epoch_us(ts) * 1000 as timestamp_ns, epoch_us(ts) * 1000 as received_at_ns,
         (['tenant-red', 'tenant-blue', 'tenant-green', ''])[user_id % 4 + 1] as namespace,
         (['accounts', 'payments', 'search', 'indexer', 'planner'])[user_id % 5 + 1] as service,
         case event_type when 'error' then 'ERROR' when 'purchase' then 'WARN' else 'INFO' end as level,
         event_type || ' event from user-' || user_id || ' [k=' || json_extract_string(props, '$.k') || ']' as message,
         json_extract_string(props, '$.k') as k, event_id
  from events),
hashed as (select *, namespace || ':' || service as s from raw_logs),
shards as (select s as s_key, ({HASH} % 16)::int as shard_id from (select distinct s from hashed)),
logs as (select *, {TOKENS} as tokens, (timestamp_ns // 86400000000000)::bigint as segment from hashed join shards on s = s_key)
"""
DOCLOGS = f"""
with raw_docs as (select 'doc-' || lpad(doc_id::varchar, 10, '0') as id, 1704067200000000000 + doc_id * 60000000000 as timestamp_ns,
                         lang as namespace, source as service, 'INFO' as level, text as message, n_chars::varchar as n_chars from documents),
doclogs as (select *, {TOKENS} as tokens from raw_docs)
"""
COLUMNS = ", ".join(SHOWN)


def add(name: str, oracle: str | None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


def search(name: str, q: LogQuery, where: str, view=logs, sql: str = LOGS, table: str = "logs") -> None:
    """Register a search without a page, as its filter."""
    add(name, f"{sql} select {COLUMNS} from {table} where {where}")(lambda spark, sf_dir: matching(view(spark, sf_dir), q).select(*SHOWN))


def has(token: str) -> str:
    return f"list_contains(tokens, '{token}')"


search("flt1_namespace", LogQuery(namespace="tenant-blue"), "namespace = 'tenant-blue'")
search("flt2_service", LogQuery(service="search"), "service = 'search'")
search("flt34_time_range", LogQuery(start_ns=JAN[5], end_ns=JAN[9]), f"timestamp_ns between {JAN[5]} and {JAN[9]}")
search("flt3_unbounded", LogQuery("signup", start_ns=-5, end_ns=0), has("signup"))
search("flt5_term", LogQuery("signup"), has("signup"))
search("flt5_term_documents", LogQuery("QUE"), has("que"), doc_logs, DOCLOGS, "doclogs")
search("flt5_no_substring", LogQuery("sign OR purch"), "false")
search("flt6_message_field", LogQuery("message:Purchase"), has("purchase"))
search("flt7_level_fold", LogQuery("level:eRRor"), "lower(level) = 'error'")
search("flt8_service_field", LogQuery("service:indexer"), "service = 'indexer'")
search("flt9_default_namespace", LogQuery("namespace:"), "namespace = ''")
search("flt10_map_field", LogQuery("k:9"), "k = '9'")
search("flt10_missing_key", LogQuery("trace: AND signup"), has("signup"))
search("flt10_documents", LogQuery("n_chars:1411 OR n_chars:715"), "n_chars in ('1411', '715')", doc_logs, DOCLOGS, "doclogs")
search("flt11_and", LogQuery("error AND service:search"), f"{has('error')} and service = 'search'")
search("flt12_or", LogQuery("signup OR purchase"), f"{has('signup')} or {has('purchase')}")
search("flt13_match_all", LogQuery(" \t "), "true")
search("flt14_field_case", LogQuery("LEVEL:warn AND K:9"), "false")
search("flt14_id_is_a_map_key", LogQuery("id:evt-0000000001"), "false")
search("lng1_brackets", LogQuery("(signup)AND(service:accounts)"), f"{has('signup')} and service = 'accounts'")
search("lng2_precedence", LogQuery("signup OR error AND service:search"), f"{has('signup')} or ({has('error')} and service = 'search')")
search("lng2_grouping", LogQuery("(error OR level:warn) AND service:search", namespace="tenant-blue"), f"({has('error')} or level = 'WARN') and service = 'search' and namespace = 'tenant-blue'")
search("lng3_first_colon", LogQuery("k:9:1 OR k:3"), "k = '3'")
search("lng4_words_not_operators", LogQuery("and OR NOT"), f"{has('and')} or {has('not')}", doc_logs, DOCLOGS, "doclogs")

FLAGSHIP = LogQuery("error AND service:search", namespace="tenant-blue", start_ns=JAN[2], end_ns=JAN[25], limit=20)
FLAGSHIP_WHERE = f"{has('error')} and service = 'search' and namespace = 'tenant-blue' and timestamp_ns between {JAN[2]} and {JAN[25]}"


@add("flagship", f"{LOGS} select {COLUMNS}, message from logs where {FLAGSHIP_WHERE} order by timestamp_ns desc, id limit 20")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching(logs(spark, sf_dir), FLAGSHIP, DEFAULT_SHARDS).select(*SHOWN, "message")
    return page(found, FLAGSHIP.limit)


@add("srt1_lim_page", f"{LOGS} select {COLUMNS} from logs where {has('purchase')} order by timestamp_ns desc, id limit 25 offset 40")
def _page(spark, sf_dir):
    return page(matching(logs(spark, sf_dir), LogQuery("purchase")).select(*SHOWN), 25, 40)


@add("lim1_offset_past_end", f"{LOGS} select {COLUMNS} from logs where false")
def _past_end(spark, sf_dir):
    return page(matching(logs(spark, sf_dir), LogQuery("k:9")).select(*SHOWN), 10, 10_000_000)


@add("lim2_default_limit", f"{DOCLOGS} select {COLUMNS} from doclogs where {has('the')} order by timestamp_ns desc, id limit 100")
def _default_limit(spark, sf_dir):
    q = LogQuery("the").checked()
    return page(matching(doc_logs(spark, sf_dir), q).select(*SHOWN), q.limit, q.offset)


@add("lim3_topk", f"{LOGS} select {COLUMNS} from logs order by timestamp_ns desc, id limit 1000")
def _topk(spark, sf_dir):
    return page(logs(spark, sf_dir).select(*SHOWN), 1000)


@add("agg1_total", f"{LOGS} select count(*) as total from logs where {has('signup')}")
def _total(spark, sf_dir):
    return matching(logs(spark, sf_dir), LogQuery("signup")).agg(F.count("*").alias("total"))


RAW = "case when event_id % 10 = 0 then '' else service end as service, case when event_id % 7 = 0 then '' else message end as message"


def _raw(spark, sf_dir):
    number = F.substring("id", 5, 10).cast("long")
    return raw_logs(spark, sf_dir).withColumns({"service": F.when(number % 10 == 0, "").otherwise(F.col("service")), "message": F.when(number % 7 == 0, "").otherwise(F.col("message"))})


@add("ing1_validate", f"{LOGS}, r as (select id, namespace, {RAW} from logs) select id, namespace, service, message from r where service <> '' and message <> ''")
def _validate(spark, sf_dir):
    return ingest.split_valid(_raw(spark, sf_dir))[0].select("id", "namespace", "service", "message")


@add("agg6_accept_reject", f"{LOGS}, r as (select {RAW} from logs) select count(*) filter (service <> '' and message <> '') as accepted, count(*) filter (service = '' or message = '') as rejected from r")
def _accepted(spark, sf_dir):
    return ingest.counts(_raw(spark, sf_dir))


@add("ing3_auto_id", None)
def _auto_id(spark, sf_dir):
    own = raw_logs(spark, sf_dir).withColumn("id", F.lit(""))
    return ingest.prepared(own).select("id", "service", "shard_id")


@add("ing4_shard", f"{LOGS} select namespace, service, shard_id, count(*) as entries from logs group by all")
def _shard(spark, sf_dir):
    return logs(spark, sf_dir).groupBy("namespace", "service", "shard_id").agg(F.count("*").alias("entries"))


@add("ing5_route", f"{LOGS} select shard_id, min(id) as first_id, max(id) as last_id from logs group by shard_id")
def _route(spark, sf_dir):
    return logs(spark, sf_dir).repartition("shard_id").groupBy("shard_id").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"))


REPLICA = f"(timestamp_ns < {JAN[15]} or (event_id % 3 = 0 and timestamp_ns < {JAN[20]})) and shard_id <> 2"


def _replica(spark, sf_dir):
    number = F.substring("id", 5, 10).cast("long")
    return logs(spark, sf_dir).where(((F.col("timestamp_ns") < JAN[15]) | ((number % 3 == 0) & (F.col("timestamp_ns") < JAN[20]))) & (F.col("shard_id") != 2))


@add(
    "ing7_catchup_antijoin",
    f"""{LOGS}, rep as (select * from logs where {REPLICA}), w as (select shard_id, max(received_at_ns) as m from rep group by 1)
    select id, shard_id, received_at_ns from logs left join w using (shard_id)
    where received_at_ns >= coalesce(m, 0) and id not in (select id from rep)""",
)
def _catch_up(spark, sf_dir):
    return ingest.catch_up(logs(spark, sf_dir), _replica(spark, sf_dir)).select("id", "shard_id", "received_at_ns")


@add("ing8_missing_segments", f"{LOGS}, rep as (select * from logs where {REPLICA}) select distinct segment, shard_id from logs where (segment, shard_id) not in (select segment, shard_id from rep)")
def _missing_segments(spark, sf_dir):
    held = _replica(spark, sf_dir).select("segment", "shard_id").distinct()
    return logs(spark, sf_dir).select("segment", "shard_id").distinct().join(held, ["segment", "shard_id"], "left_anti")


@add("ing9_high_water", f"{LOGS} select shard_id, max(received_at_ns) as high_water_ns from logs group by 1")
def _high_water(spark, sf_dir):
    return ingest.high_water(logs(spark, sf_dir))


@add("ing10_boundary_ids", f"{LOGS}, w as (select shard_id, max(received_at_ns) as m from logs group by 1) select id, shard_id from logs join w using (shard_id) where received_at_ns >= m - 3600000000000")
def _boundary(spark, sf_dir):
    own = logs(spark, sf_dir)
    mark = ingest.high_water(own).withColumnRenamed("shard_id", "s")
    return own.join(mark, F.col("shard_id") == F.col("s")).where(F.col("received_at_ns") >= F.col("high_water_ns") - 3_600_000_000_000).select("id", "shard_id")


@add("src7_wrong_shard", f"{LOGS} select id, shard_id from logs where event_id % 50 = 0")
def _wrong(spark, sf_dir):
    number = F.substring("id", 5, 10).cast("long")
    moved = logs(spark, sf_dir).withColumn("shard_id", F.when(number % 50 == 0, (F.col("shard_id") + 1) % 16).otherwise(F.col("shard_id")))
    return ingest.wrong_shard(moved).select("id", "shard_id")


@add("src8_fetch_since", f"{LOGS} select id, received_at_ns from logs where shard_id = 15 and received_at_ns >= {JAN[20]}")
def _fetch(spark, sf_dir):
    return ingest.fetch_since(logs(spark, sf_dir), 15, JAN[20]).select("id", "received_at_ns")


@add("src9_shard_segments", f"{LOGS} select distinct segment from logs where shard_id = 4")
def _shard_segments(spark, sf_dir):
    return shard_segments(logs(spark, sf_dir), 4)


@add("src10_export", f"{LOGS} select {COLUMNS} from logs where segment = 19730 and shard_id = 15")
def _export(spark, sf_dir):
    return logs(spark, sf_dir).where("segment = 19730 and shard_id = 15").select(*SHOWN)


@add("fn1_tokenize", f"{DOCLOGS} select id, len({TOKENS}) as tokens, len(list_distinct({TOKENS})) as kinds from doclogs")
def _tokenize(spark, sf_dir):
    return doc_logs(spark, sf_dir).select("id", F.size(all_tokens("message")).cast("long").alias("tokens"), F.size("tokens").cast("long").alias("kinds"))


@add("idx1_postings", f"{LOGS}, p as (select distinct unnest(tokens) as token, segment from logs) select token, count(*) as segments from p group by 1")
def _postings(spark, sf_dir):
    return index.postings(logs(spark, sf_dir)).groupBy("token").agg(F.count("*").alias("segments"))


@add("idx2_zone_map", f"{LOGS} select segment, min(timestamp_ns) as min_ns, max(timestamp_ns) as max_ns from logs group by 1")
def _zones(spark, sf_dir):
    return index.zone_map(logs(spark, sf_dir))


@add(
    "idx3_resolve",
    f"""{LOGS}, p as (select distinct unnest(tokens) as token, segment from logs)
    select segment from logs group by segment
    having max(timestamp_ns) >= {JAN[3]} and min(timestamp_ns) <= {JAN[28]} and count(*) filter (service = 'search') > 0 and count(*) filter (namespace = 'tenant-blue') > 0
       and segment in (select segment from p where token in ('error', '9') group by segment having count(*) = 2)""",
)
def _resolve(spark, sf_dir):
    own = logs(spark, sf_dir)
    return index.resolve(index.postings(own), index.label_postings(own), index.zone_map(own), ["error", "9"], "tenant-blue", "search", JAN[3], JAN[28])


@add("idx4_pruned_search", f"{LOGS} select {COLUMNS} from logs where {has('error')} and {has('9')} and service = 'search'")
def _pruned(spark, sf_dir):
    own, q = logs(spark, sf_dir), LogQuery("error AND 9", service="search")
    kept = index.resolve(index.postings(own), index.label_postings(own), index.zone_map(own), required_tokens(parse(q.query)), service=q.service)
    return matching(index.prune(own, kept), q).select(*SHOWN)


@add("idx5_token_count", f"{DOCLOGS} select count(distinct t) as tokens from (select unnest(tokens) as t from doclogs)")
def _token_count(spark, sf_dir):
    return index.token_count(doc_logs(spark, sf_dir).select(F.explode("tokens").alias("token")))


@add("idx6_remove_segment", f"{LOGS}, p as (select distinct unnest(tokens) as token, segment from logs where segment >= 19735) select token, count(*) as segments from p group by 1")
def _removed(spark, sf_dir):
    own = index.postings(logs(spark, sf_dir))
    return index.without_segments(own, own.select("segment").distinct().where("segment < 19735")).groupBy("token").agg(F.count("*").alias("segments"))


COPIES = "select *, 0 as copy from logs union all select * replace ('COPY' as level, segment + 1 as segment), 1 as copy from logs where service = 'accounts'"


def _with_copies(spark, sf_dir):
    own = logs(spark, sf_dir)
    again = own.where("service = 'accounts'").withColumns({"level": F.lit("COPY"), "segment": F.col("segment") + 1})
    return own.unionByName(again)


@add("ddp1_dedup", f"{LOGS}, c as ({COPIES}) select {COLUMNS} from c qualify row_number() over (partition by id order by segment, copy) = 1")
def _dedup(spark, sf_dir):
    return first_by_id(_with_copies(spark, sf_dir), "segment").select(*SHOWN)


@add("ddp2_count", f"{LOGS}, c as ({COPIES}) select count(distinct id) as entries from c")
def _distinct(spark, sf_dir):
    return _with_copies(spark, sf_dir).dropDuplicates(["id"]).agg(F.count("*").alias("entries"))


@add("dq4_merge", f"{LOGS} select {COLUMNS} from logs where {has('signup')} order by timestamp_ns desc, id limit 50 offset 10")
def _merge(spark, sf_dir):
    own = matching(logs(spark, sf_dir), LogQuery("signup"))
    parts = [own.where("service in ('accounts', 'search')"), own.where("service <> 'accounts'")]
    return page(merged(parts).select(*SHOWN), 50, 10)


@add("dq1_shard_pruned", f"{LOGS} select {COLUMNS} from logs where namespace = 'tenant-blue' and service = 'search'")
def _shard_pruned(spark, sf_dir):
    return matching(logs(spark, sf_dir), LogQuery(namespace="tenant-blue", service="search"), DEFAULT_SHARDS).select(*SHOWN)


def _sizes(spark, sf_dir):
    return logs(spark, sf_dir).groupBy("segment").agg(F.sum(F.length("message")).alias("bytes"))


@add(
    "mnt1_merge_runs",
    f"""{LOGS}, s as (select segment, sum(length(message)) as bytes from logs group by 1),
    m as (select avg(bytes) as m from s), p as (select segment, bytes < m as small, row_number() over (order by segment) as r from s, m),
    i as (select segment, r - row_number() over (order by segment) as g from p where small)
    select segment, min(segment) over (partition by g) as run from i qualify count(*) over (partition by g) > 1""",
)
def _runs(spark, sf_dir):
    sizes = _sizes(spark, sf_dir)
    mean = sizes.agg(F.avg("bytes").alias("mean"))
    small = sizes.join(F.broadcast(mean)).withColumn("bytes", F.when(F.col("bytes") < F.col("mean"), 0).otherwise(1))  # the mean is one row
    return maintenance.merge_runs(small.select("segment", "bytes"), 1)


@add("mnt2_retention", f"{LOGS} select segment from logs group by 1 having max(timestamp_ns) > 0 and max(timestamp_ns) < {JAN[15]} - 7 * 86400000000000")
def _retention(spark, sf_dir):
    return maintenance.expired(index.zone_map(logs(spark, sf_dir)), JAN[15], 7).select("segment")


NODES = "with n as (select n_name as node_id, n_nationkey::bigint * 1000000000 as last_seen_ns, 30000000000 - n_nationkey::bigint * 1000000000 <= 15000000000 as healthy from nation)"


def _nodes(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return cluster.live(n.select(F.col("n_name").alias("node_id"), (F.col("n_nationkey").cast("long") * 1_000_000_000).alias("last_seen_ns")), 30_000_000_000)


PLACED = f"{NODES}, h as (select node_id, row_number() over (order by node_id) - 1 as i from n where healthy), c as (select count(*) as c from h), p as (select s::int as shard_id, h.node_id as primary from range(16) t(s), c, h where h.i = s % c)"


@add("ctl1_primary", f'{PLACED} select shard_id, "primary" from p')
def _primary(spark, sf_dir):
    return cluster.assign(spark, _nodes(spark, sf_dir), 16).select("shard_id", "primary")


@add("ctl2_replica", f'{PLACED} select shard_id, min(node_id) as replica from p join h on h.node_id <> p."primary" group by 1')
def _replicas(spark, sf_dir):
    return cluster.assign(spark, _nodes(spark, sf_dir), 16).select("shard_id", "replica")


@add("ctl4_liveness", f"{NODES} select node_id, healthy from n")
def _liveness(spark, sf_dir):
    return _nodes(spark, sf_dir).select("node_id", "healthy")


@add("snk8_status", f'{PLACED} select "primary", count(*) as shards from p group by 1')
def _status(spark, sf_dir):
    return cluster.status(cluster.assign(spark, _nodes(spark, sf_dir), 16))


@add("agg8_rates", f"{LOGS} select timestamp_ns // 300000000000 * 300 as start_s, level, count(*) as entries from logs group by 1, 2")
def _rates(spark, sf_dir):
    return rates(logs(spark, sf_dir)).select(F.unix_seconds("w.start").alias("start_s"), "level", "entries")
