"""The versioned store: merges, conflicts, reopening, transactions, roots, version verbs; and known answers of a hash."""

import itertools

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import sql
from tidemark.operators import dml, placement, temporal
from tidemark.plans.paths import Conflict, scratch
from tidemark.plans.store import Store
from tidemark.plans.tenants import Tenant


def store_of(spark, rows=((1, "a"), (2, "b"), (3, "c"))):
    ticks = itertools.count(1_700_000_000_000_000_000, 10**9)
    store = Store(spark, scratch(spark, "store"), lambda: next(ticks))
    store.create("t", spark.createDataFrame(list(rows), "id long, v string"), "id")
    return store, store.commit("load")


def put(store, row, value):
    t = store.table("t")
    store.put("t", t.withColumn("v", F.when(F.col("id") == row, value).otherwise(F.col("v"))))
    return store.commit(f"{row} {value}")


def rows(store):
    return sorted((r.id, r.v) for r in store.table("t").collect())


def test_merging_a_branch_again_starts_from_the_merge(spark):
    store, _ = store_of(spark)
    store.create_branch("side")
    store.checkout("side")
    put(store, 1, "side")
    store.checkout("main")
    put(store, 2, "main")
    store.merge_three_way("side")
    put(store, 1, "main again")
    store.checkout("side")
    put(store, 3, "side again")
    store.checkout("main")
    store.merge_three_way("side")
    assert rows(store) == [(1, "main again"), (2, "main"), (3, "side again")]
    store.checkout("side")
    put(store, 2, "theirs")
    store.checkout("main")
    put(store, 2, "ours")
    with pytest.raises(Conflict):
        store.merge_three_way("side")
    store.checkout("main")
    store.put("t", store.table("t").where("id > 1"))
    with pytest.raises(RuntimeError, match="not committed"):
        store.merge_three_way("side")


def test_equal_rows_have_equal_roots(spark):
    a, first = store_of(spark)
    b, second = store_of(spark, ((3, "c"), (1, "a"), (2, "b")))
    c, third = store_of(spark, ((3, "c"), (1, "a"), (2, "x")))
    assert a.manifest(first)["root"] == b.manifest(second)["root"] != c.manifest(third)["root"]


def test_a_stale_base_and_a_lost_race_are_conflicts(spark):
    store, _ = store_of(spark)
    late = Store(spark, store.path)
    assert rows(late) == rows(store)  # reopened
    put(store, 1, "x")
    with pytest.raises(Conflict):
        put(late, 2, "y")
    with pytest.raises(Conflict):
        store._point("main", store.head(), 1)  # of two writers of one number one loses
    store.create_branch("old", next(m["id"] for m in store.chain() if m["message"] == "load"))
    store.checkout("old")
    put(store, 3, "z")
    with pytest.raises(Conflict):  # no fast-forward of lines that have parted
        store.merge("main")


def test_transactions_drop_and_verbs(spark):
    store, first = store_of(spark)
    store.begin()
    with pytest.raises(RuntimeError):
        store.begin()
    store.drop("t")
    store.rollback()
    assert len(rows(store)) == 3
    second = put(store, 1, "x")
    assert sql.run(store, f"SELECT vc_diff('{first}', '{second}')").select("key", "kind").collect() == [("1", "modified")]
    assert sql.run(store, "SELECT vc_current_branch()").first()[0] == "main"
    assert [r.message for r in sql.run(store, "SELECT vc_log(2)").collect()] == ["1 x", "load"]
    store.drop("t")
    store.commit("drop")
    assert "t" not in Store(spark, store.path).working


def test_murmur3_known_answers(spark):
    df = spark.createDataFrame([("",), ("hello",), ("hello, world",)], "k string")
    got = [r.h & 0xFFFFFFFF for r in df.select(placement.murmur3("k").alias("h")).collect()]
    assert got == [0, 0x248BFA47, 0x149BBB7F]
    texts = ["", "é", "hello", "a" * 1_001, "hello, world", "abcd", "hell"]
    alone = [placement.murmur3.func(pd.Series([t]))[0] for t in texts]
    assert placement.murmur3.func(pd.Series([*texts, None])).tolist() == [*alone, 0]


def test_tenants_do_not_see_each_other(spark):
    store, _ = store_of(spark)
    a, b = Tenant(store, "a"), Tenant(store, "b")
    a.create("items", spark.createDataFrame([(1, 100), (2, 200)], "id long, qty long"), "id")
    b.create("items", spark.createDataFrame([(1, 999)], "id long, qty long"), "id")
    store.commit("both")
    assert a.sql("SELECT sum(qty) AS n FROM items").first().n == 300 and b.sql("SELECT sum(qty) AS n FROM items").first().n == 999
    a.put("items", a.table("items").where("id > 1"))
    assert a.sql("SELECT sum(qty) AS n FROM items").first().n == 200 and b.tables() == ["items"]
    with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND"):
        b.sql("SELECT * FROM __tenant_a__items")
    b.drop("items")
    assert b.tables() == [] and a.table("items").count() == 1
    with pytest.raises(ValueError):
        Tenant(store, "a__b'")


def test_conflict_target_and_cutoff(spark):
    df = spark.createDataFrame([(1, "a")], "id long, v string")
    with pytest.raises(ValueError):
        dml.upsert(df, df, "id", target="v")
    assert dml.upsert(df, df, "id", target="id").count() == 1
    log = spark.createDataFrame([(1, 5, "replace", "x"), (1, 9, "append", "y")], "page long, lsn long, kind string, delta string")
    assert temporal.replay_at(log, "page", "lsn", "kind", "delta", 9, cutoff=5).first().image == "xy"
    with pytest.raises(ValueError, match="cutoff"):
        temporal.replay_at(log, "page", "lsn", "kind", "delta", 4, cutoff=5)
