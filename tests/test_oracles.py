from __future__ import annotations

import pytest

from studylake.plans.archive import ORACLES, QUERIES

from .oracle import SMALL, connection, rows


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, name):
    got, want = QUERIES[name](spark, SMALL).toPandas(), con.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["win_ingest_outcome", "agg_study_totals", "jn_fuzzy_names"])
def test_partition_count_does_not_matter(spark, name):
    one = rows(QUERIES[name](spark, SMALL).toPandas())
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert rows(QUERIES[name](spark, SMALL).toPandas()) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_native_queries_have_no_python_node(spark):
    for name in sorted(QUERIES):
        if not name.startswith("udf_"):
            plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
            assert not any(x in plan for x in ("Python", "Pandas", "ArrowEval")), name


def test_verify_finds_every_kind_of_damage(spark):
    """Each document's blob is checked, and content under a wrong name is told from a lost blob."""
    found = QUERIES["int_verify_each"](spark, SMALL)
    assert {r.verdict for r in found.select("verdict").distinct().collect()} == {"ok", "mismatch", "unreadable", "gone"}
    assert found.where("verdict <> 'gone'").count() >= spark.read.parquet(f"{SMALL}/documents.parquet").select("text").distinct().count()
