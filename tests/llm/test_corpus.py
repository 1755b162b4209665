"""The registered queries against SQL, and the pipeline stage by stage."""

import pytest

import corpus_pipeline
from emberlog.llm import queries

from ..conftest import DATA
from .test_operators import TEXTS, brute_components, brute_lines


def rows(frame, columns):
    return sorted(map(str, frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_same_as_sql(spark, duck, name):
    have, want = queries.QUERIES[name](spark, f"{DATA}/sf0.001").toPandas(), duck.execute(queries.ORACLES[name]).df()
    assert rows(have, sorted(have.columns)) == rows(want, sorted(want.columns))


def test_pipeline_stages(spark):
    sf_dir = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        out[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    kept = {r.doc_id for r in out["language_id"]}
    assert len(kept) >= 0.95 * len(before)
    lines = {d: t for d, t, _, _ in brute_lines([(d, t) for d, t in before.items() if d in kept])}
    assert {r.doc_id: r.text for r in out["line_dedup"]} == lines
    least = {c for _, n, c in brute_components(list(lines.items())) if n} | {d for d, n, c in brute_components(list(lines.items())) if not n}
    assert {r.doc_id for r in out["jaccard_join"]} == least
    assert {r.doc_id for r in out["mixing"]} <= least
    assert {r.doc_id for r in out["packing"]} == {r.doc_id for r in out["mixing"]}


def test_stages_on_odd_and_empty_tables(spark):
    sf_dir = f"{DATA}/sf0.001"
    clash = "doc_id long, text string, lang string, source string, n_chars long, score double, rejected boolean, lang_pred string, kept_text string, n_lines long, n_dropped long, size long, h long, comp long, copies int"
    known = [(100 + i, f"the cat sat on the mat number {i} and looked at the other cats there", "en") for i in range(60)]
    rows = [(d, t, "en" if lang is None else lang, None if d is None else f"s{d % 3}", 7, 0.5, True, "xx", "k", 1, 2, 3, 4, 5, 6) for d, t, lang in [(d, t, None) for d, t in TEXTS] + known]
    table = spark.createDataFrame(rows, clash)
    for docs in (table, table.limit(0)):
        left = []
        for name, stage in corpus_pipeline.STAGES:
            given = docs
            docs = stage(spark, given, sf_dir)
            if name != "packing":
                assert docs.columns == given.columns
            docs = docs.cache()
            left.append(docs.count())
            if name in ("language_id", "jaccard_join"):  # rows go or stay as they are
                assert docs.exceptAll(given).count() == 0
            if name == "line_dedup":
                assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=str) == sorted(((d, t) for d, t, _, _ in brute_lines([(r.doc_id, r.text) for r in given.collect()])), key=str)
        assert (left[0] >= 60 and left[0] == left[1] >= left[2] > 0 and left[4] > 0) if given is not docs and left[0] else left == [0] * 5
