"""Every query with SQL gives what DuckDB gives; shuffling the input changes nothing."""

import pytest
from compare import assert_same, duck

from declarium import queries as core


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, sf, con, name):
    got = core.QUERIES[name](spark, sf).toPandas()
    if name in core.ORACLES:
        assert_same(got, con.execute(core.ORACLES[name]).fetchdf())
    else:
        assert len(got)


@pytest.mark.parametrize("name", ["q_merge_first_wins", "q_edge_dedup_exact", "q_depends_on", "q_best_detection"])
def test_row_order_is_irrelevant(spark, sf, tmp_path, name):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet")
    rows.orderBy("l_comment" if "l_comment" in rows.columns else "l_extendedprice").repartition(7).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert_same(core.QUERIES[name](spark, str(tmp_path)).toPandas(), core.QUERIES[name](spark, sf).toPandas())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(core.QUERIES) <= set(__spark_entry__.queries())


def test_pin_conflicts_of_every_part(spark, sf, con):
    want = con.execute("SELECT count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_linenumber % 3 <> 0 GROUP BY 1 HAVING count(DISTINCT (l_suppkey % 12, l_linenumber % 2)) > 1)").fetchone()[0]
    assert core.QUERIES["q_pin_conflict"](spark, sf).count() == want > 0
