"""Queries that add rows under higher keys against their SQL, on orders that have these keys already."""

import duckdb
import pytest

from test_oracles import values
from tidemark import catalogue
from tidemark.plans.store import Store


@pytest.fixture(scope="module")
def met(spark, tmp_path_factory):
    """Orders of keys that meet when 1,000,000 or 6,000,000 are added, with and without other columns alike."""
    path = str(tmp_path_factory.mktemp("met"))
    keys = [k + base for base in (-1_000_000, 0, 1_000_000, 2_000_000, 6_000_000, 7_000_000, 12_000_000) for k in range(-30, 90)]
    orders = [(k, k // 1_000_000 + k % 7 if k % 4 else k % 7, "FOP"[(k % 1000 // 10 + k // 4_000_000) % 3], (k % 13) / 4) for k in keys]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double").write.parquet(f"{path}/orders.parquet")
    spark.range(-1, 19).selectExpr("id AS c_custkey", "concat('s', id % 3) AS c_mktsegment").write.parquet(f"{path}/customer.parquet")
    return path


def same(spark, path, name):
    con = duckdb.connect()
    for t in ("orders", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    want = values(con.execute(catalogue.ORACLES[name]).df())
    return want[1] and values(catalogue.QUERIES[name](spark, path).toPandas()) == want


@pytest.mark.parametrize("name", ["diff_rows", "diff_counts", "change_feed", "flagship", "dml_upsert_nothing", "dml_upsert_excluded", "shard_rows", "sql_statements"])
def test_sql_holds_where_keys_meet(spark, met, name):
    assert same(spark, met, name)


def test_diff_compares_all_columns_unless_some_are_named(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.create("t", spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, "a", 1)], "k long, v string, w long"), "k")
    first = store.commit("load")
    store.put("t", spark.createDataFrame([(1, "b", 1), (2, "a", 2), (4, "a", 1)], "k long, v string, w long"))
    second = store.commit("edit")
    found = lambda *more: sorted((r.key, r.kind) for r in store.diff(first, second, *more).collect())
    ends = [("3", "removed"), ("4", "added")]
    assert found() == [("1", "modified"), ("2", "modified"), *ends]
    assert found({"t": ["v"]}) == [("1", "modified"), *ends]
