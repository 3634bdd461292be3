"""Every query against its oracle; those without one must give rows."""

import pytest

from harness import connect, difference
from parlance.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    assert len(set(df.columns)) == len(df.columns)
    if name in ORACLES:
        assert difference(df, con, ORACLES[name]) == ""
    else:
        assert df.limit(1).count() == 1


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns[0] == "userId"
    assert set(e.oracle_sql()) <= set(e.queries())


def test_no_text_or_page_is_left_out(spark, sf_dir):
    points = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    rows = QUERIES["context_join_all"](spark, sf_dir).collect()
    assert sum(len(r.context.split("\n\n---\n\n")) for r in rows) == points
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()
    there = {r.url for r in pages if r.page_id % 3 == 1}
    assert {r.url for r in QUERIES["bulk_insert_all"](spark, sf_dir).collect()} == {r.url for r in pages} - there


def test_no_visitor_or_point_is_left_out(spark, sf_dir):
    points = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    assert QUERIES["knn_join_all"](spark, sf_dir).select("q").distinct().count() == points
    assert QUERIES["same_ip_all"](spark, sf_dir).filter("id >= 50").count() > 0
