import pytest

import __spark_entry__ as entry
from emberlog.plans import catalogue

from .conftest import DATA


def rows(frame, columns):
    return sorted(map(str, frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_same_as_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, f"{DATA}/sf0.001").toPandas()
    if name not in catalogue.ORACLES:
        assert len(got)
        return
    want = duck.execute(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_entry_and_registry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == [*catalogue.SHOWN, "message"]


def test_plans_prune_and_push_down(spark, tmp_path):
    from emberlog.engine import LogStore
    from emberlog.operators.search import LogQuery, page
    from emberlog.sources.views import raw_logs

    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    engine = LogStore(spark, str(tmp_path / "logs"))
    engine.ingest_batch(raw_logs(spark, f"{DATA}/sf0.001"))
    found = page(engine.find(LogQuery("error", "tenant-blue", "search", start_ns=catalogue.JAN[2], end_ns=catalogue.JAN[9])).select("id", "timestamp_ns"), 10)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan
    filters = plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert "shard_id" in filters and "event_date" in filters
    assert "GreaterThanOrEqual(timestamp_ns" in plan.split("PushedFilters: ")[1]
    assert "fields" not in plan.split("ReadSchema: ")[1]
