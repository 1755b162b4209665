"""The corpus operators as queries over the driver's tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, read
from .exact_dedup import exact_dedup
from .lang_id import identify, train
from .line_dedup import line_dedup
from .mixing import mix
from .packing import pack_documents
from .quality_rank import rank_quality
from .quality_rules import quality_rules
from .shingle_join import shingle_components
from .toxicity import score_toxicity
from .url_filter import filter_urls


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_components(read(spark, sf_dir, "documents"))


def op3_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents")).drop("host", "n_lines", "host_kept")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack_documents(read(spark, sf_dir, "documents"), vocabulary())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return identify(docs, train(docs), ["doc_id"]).select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_url_filter, op2_jaccard_join, op3_quality_rank, op4_exact_dedup, op5_line_dedup, op6_quality_rules, op7_packing, op8_toxicity, op9_language_id, op10_mixing)}

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op2_jaccard_join": rf"""
        with recursive
             a as (select doc_id, list_filter(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
             g as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
                          else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from a),
             n as (select doc_id, count(*) as n from g group by doc_id),
             p as (select x.doc_id as a, y.doc_id as b, count(*) as o from g x join g y on x.s = y.s and x.doc_id < y.doc_id group by 1, 2),
             l as materialized (select a, b from p join n na on a = na.doc_id join n nb on b = nb.doc_id where 100 * o >= 75 * (na.n + nb.n - o)),
             e as materialized (select a, b from l union all select b, a from l),
             r as (select doc_id, doc_id as m from documents union select e.b, r.m from r join e on e.a = r.doc_id)
        select d.doc_id, coalesce(n.n, 0) as n_shingles, min(r.m) as component_id
        from documents d left join n using (doc_id) join r using (doc_id) group by 1, 2""",
    "op4_exact_dedup": f"""
        with t as (select doc_id, {LOWER.format("coalesce(text, '')")} as x from documents)
        select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
               doc_id = max(doc_id) over g as kept, sha256(x) as text_sha256
        from t window g as (partition by x)""",
    "op5_line_dedup": f"""
        with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
                          generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents),
             k as (select *, {LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} as key from l),
             m as (select *, length(key) >= 10 and doc_id > min(doc_id) over (partition by key) as gone from k)
        select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
               sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
        from m group by doc_id""",
    "op6_quality_rules": r"""
        with t as (select doc_id, source, coalesce(text, '') as x from documents),
             a as (select doc_id, source, x, list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda w: w <> '') as w,
                          list_filter(string_split(x, chr(10)), lambda v: regexp_matches(v, '[^\x20\x09-\x0D]')) as l from t),
             g as (select doc_id, unnest(range(1, len(w) - 1)) as i, w from a where len(w) >= 3),
             h as (select doc_id, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2]) as n from g),
             r as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from h where n > 1) group by doc_id),
             c as (select a.doc_id, source, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
                          length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) as n_symbols, len(l) as n_lines,
                          len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words
                   from a left join r using (doc_id)),
             f as (select *, n_words < 50 as f1, 100 * n_repeat_words > 50 * n_words as f2, 10 * n_symbols > n_words as f3,
                          10 * n_dup_lines > 3 * n_lines as f4 from c),
             s as (select source, count(*) as n, count(*) filter (f1) as k1, count(*) filter (f2) as k2,
                          count(*) filter (f3) as k3, count(*) filter (f4) as k4 from f group by source),
             v as (select source, n, unnest([k1, k2, k3, k4]) as k, unnest([1, 2, 3, 4]) as rule from s),
             p as (select rule, avg(k / n) as m, var_pop(k / n) as q from v group by rule),
             z as (select source, max((k + m * b) / (n + b)) <= 0.5 as ok
                   from (select *, case when q > 0 then greatest(1, least(10000, m * (1 - m) / q - 1)) else 10000 end as b
                         from v join p using (rule)) group by source)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 or f2 as base_failed, not (f1 or f2) and ok as kept
        from f join z on f.source is not distinct from z.source""",
}
