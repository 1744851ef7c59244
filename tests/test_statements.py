"""Statements, idempotent runs, backups by commit, caches, federated sources, shards: what the queries do not show."""

import itertools

import pytest
from pyspark.sql import functions as F

from tidemark import sql
from tidemark.operators import integrity, placement, temporal
from tidemark.plans.cache import Cache
from tidemark.plans.paths import scratch
from tidemark.plans.store import Store
from tidemark.sources import io


@pytest.fixture
def store(spark):
    ticks = itertools.count(1_700_000_000_000_000_000, 10**9)
    return Store(spark, scratch(spark, "store"), lambda: next(ticks))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def tag(store, text, args=None):
    return sql.run(store, text, args).first().command


def test_statements(store):
    assert tag(store, "CREATE TABLE IF NOT EXISTS t (id INT PRIMARY KEY, v VARCHAR(20), n DOUBLE PRECISION, PRIMARY KEY (id));") == "CREATE TABLE"
    assert store.table("t").dtypes == [("id", "bigint"), ("v", "string"), ("n", "double")]
    assert tag(store, "INSERT INTO t VALUES (1, 'a, b', 1), (2, 'it''s ON CONFLICT DO NOTHING', 2)") == "INSERT 2"
    assert tag(store, "INSERT INTO t (v, id) VALUES ('(c', '3')") == "INSERT 1"
    assert tag(store, "INSERT INTO t (id, v) VALUES (1, 'x'), (4, 'd') ON CONFLICT DO NOTHING") == "INSERT 2"
    assert rows(store.table("t").select("id", "v")) == [(1, "a, b"), (2, "it's ON CONFLICT DO NOTHING"), (3, "(c"), (4, "d")]
    assert tag(store, "INSERT INTO t (id, v) VALUES (4, 'e') ON CONFLICT (id) DO UPDATE SET v = concat(v, ',', excluded.v), n = 7") == "INSERT 1"
    assert tag(store, "UPDATE t SET v = concat('WHERE, ', v), n = :n WHERE id > :low AND n IS NULL", {"n": 5, "low": 2}) == "UPDATE 1"
    assert tag(store, "DELETE FROM t WHERE n = 2") == "DELETE 1"
    assert tag(store, "DELETE FROM t WHERE v = NULL") == "DELETE 0"
    assert rows(store.table("t")) == [(1, "a, b", 1.0), (3, "WHERE, (c", 5.0), (4, "d,e", 7.0)]
    for text, error in (
        ("INSERT INTO t VALUES (9, 'a', 1), (9, 'b', 1)", ValueError),
        ("INSERT INTO t (v) VALUES ('no key')", ValueError),
        ("INSERT INTO t (id, v) VALUES (1, 'x') ON CONFLICT (v) DO NOTHING", ValueError),
        ("UPDATE t SET w = 1", ValueError),
        ("DELETE FROM u", KeyError),
    ):
        with pytest.raises(error):
            sql.run(store, text)
    assert tag(store, "BEGIN") == "BEGIN"
    sql.run(store, "DELETE FROM t")
    assert store.table("t").isEmpty()
    assert tag(store, "ROLLBACK") == "ROLLBACK"
    assert store.table("t").count() == 3
    assert tag(store, "DROP TABLE IF EXISTS u") == tag(store, "DROP TABLE t") == "DROP TABLE"
    assert "t" not in store.working


def test_versions_by_time_and_in_order(store):
    sql.run(store, "CREATE TABLE t (id INT, v TEXT)")
    sql.run(store, "INSERT INTO t VALUES (3, 'c'), (1, 'a'), (2, 'b')")
    first = sql.run(store, "SELECT vc_commit('one')").first()[0]
    sql.run(store, "DELETE FROM t WHERE id < 3")
    sql.run(store, "SELECT vc_commit('two')")
    assert [r.id for r in sql.run(store, f"SELECT * FROM t AS OF COMMIT '{first}'").collect()] == [1, 2, 3]
    at = store.manifest(first)["ts"]
    text = f"2023-11-14 22:13:{20 + (at - 1_700_000_000_000_000_000) // 10**9:02d}"
    assert sql.run(store, f"SELECT count(*) AS n FROM t AS OF TIMESTAMP '{text}' WHERE id > 1").first().n == 2
    assert sql.run(store, f"SELECT a.id FROM t AS OF TIMESTAMP {at} a LEFT ANTI JOIN t b ON a.id = b.id").count() == 2
    with pytest.raises(KeyError):
        sql.run(store, "SELECT * FROM t AS OF TIMESTAMP '2001-01-01'")


def test_a_statement_runs_once_for_its_key(store):
    sql.run(store, "CREATE TABLE t (id INT, n INT)")
    sql.run(store, "INSERT INTO t VALUES (1, 10)")
    for _ in range(2):
        assert sql.run_once(store, "k1", "UPDATE t SET n = n + 1", "add").first().command == "UPDATE 1"
    assert rows(store.table("t")) == [(1, 11)]
    assert rows(sql.run_once(store, "k2", "SELECT n FROM t")) == [(11,)]
    sql.run_once(store, "k3", "UPDATE t SET n = 0")
    assert rows(sql.run_once(store, "k2", "SELECT n FROM t")) == [(11,)]  # the stored result
    late = Store(store.spark, store.path)
    assert sql.run_once(late, "k3", "UPDATE t SET n = 5").first().command == "UPDATE 1"
    assert rows(late.table("t")) == [(1, 0)]
    assert len(list(store.chain())) == 4  # genesis and one commit for each key


def test_a_run_that_ended_before_its_commit_is_run_again(store, monkeypatch):
    sql.run(store, "CREATE TABLE t (id INT, n INT)")
    sql.run(store, "INSERT INTO t VALUES (1, 10)")
    store.commit("load")

    def ends(*_, **__):
        raise RuntimeError("ended")

    monkeypatch.setattr(store, "commit", ends)
    with pytest.raises(RuntimeError):
        sql.run_once(store, "k", "UPDATE t SET n = n + 1")
    late = Store(store.spark, store.path)
    for _ in range(2):
        sql.run_once(late, "k", "UPDATE t SET n = n + 1")
    assert rows(late.table("t")) == [(1, 11)]


def test_backups_of_commits_and_changes(spark, store):
    path = scratch(spark, "backups")
    store.create("t", spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, v string"))
    store.create("same", spark.createDataFrame([(1,)], "id long"))
    a = store.commit("a")
    sql.run(store, "UPDATE t SET v = 'x' WHERE id = 2")
    sql.run(store, "DELETE FROM t WHERE id = 1")
    b = store.commit("b")
    store.drop("same")
    store.create("new", spark.createDataFrame([(7,)], "id long"))
    c = store.commit("c")
    full = io.backup_commit(store, a, path)
    one = io.backup_changes(store, full, b, path)
    two = io.backup_changes(store, one, c, path)
    io.kept(spark, f"{path}/unfinished/t", store.table("t"), "zstd")
    assert io.backups(spark, path) == [two, one, full]
    assert rows(io.restore(spark, path, full)["t"]) == rows(store.as_of("t", a))
    assert rows(io.restore(spark, path, one)["t"]) == [(2, "x"), (3, None)]
    found = io.restore(spark, path, two)
    assert sorted(found) == ["new", "t"] and rows(found["new"]) == [(7,)] and rows(found["t"]) == [(2, "x"), (3, None)]
    later = io.backup_commit(store, c, path)
    assert io.expire(spark, path, 2) == []  # the second newest needs the others
    assert sorted(io.expire(spark, path, 1)) == sorted([full, one, two]) and io.backups(spark, path) == [later]
    spark.createDataFrame([(9,)], "id long").write.mode("overwrite").parquet(f"{path}/{later}/new")
    with pytest.raises(ValueError, match="not the rows"):
        io.restore(spark, path, later)


def test_cache_reads_what_changed(store):
    sql.run(store, "CREATE TABLE t (id INT, n INT)")
    sql.run(store, "INSERT INTO t VALUES (1, 10), (2, 20), (3, 30)")
    a = store.commit("a")
    sql.run(store, "UPDATE t SET n = 0 WHERE id = 2")
    sql.run(store, "DELETE FROM t WHERE id = 3")
    b = store.commit("b")
    held = Cache(store, size=1)
    assert held.sql("SELECT sum(n) AS n FROM t", a).first().n == 60
    assert rows(held.table("t")) == [(1, 10), (2, 0)] and (held.full, held.refreshed) == (1, 1)
    assert held.table("t", b) is held.table("t") and len(held.held) == 1
    held.clear()


def test_databases_and_joins_across_sources(spark, store, tmp_path):
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", str(tmp_path / "derby.log"))
    url = "jdbc:derby:memory:tidemark;create=true"
    spark.createDataFrame([(1, "one"), (2, "two")], "id int, name string").write.jdbc(url, "names")
    assert "APP.NAMES" in io.list_tables(spark, url)
    (tmp_path / "n.csv").write_text("id,n\n1,5\n2,6\n3,7\n")
    io.federate(spark, {"local.far_names": ("jdbc", url, {"table": "names"}), "near_counts": ("csv", str(tmp_path / "n.csv"), {})})
    joined = spark.sql("SELECT name, n FROM far_names JOIN near_counts ON far_names.id = CAST(near_counts.id AS INT)")
    assert rows(joined) == [("one", "5"), ("two", "6")]
    assert io.migrate(store, "jdbc", url, "names", "ID", table="names") == {"read": 2, "inserted": 2, "set_aside": 0}
    assert io.migrate(store, "jdbc", url, "names", "ID", table="names") == {"read": 2, "inserted": 0, "set_aside": 0}


def test_mysql_definitions():
    text = "CREATE TABLE `t` (`a` INT UNSIGNED, `b` TINYINT(1) DEFAULT '`', `c` DATETIME)"
    assert io.mysql_ddl(text) == "CREATE TABLE \"t\" (\"a\" BIGINT, \"b\" BOOLEAN DEFAULT '`', \"c\" TIMESTAMP)"


def test_a_row_with_another_checksum_ends_the_scan(spark):
    df = integrity.sealed(spark.createDataFrame([(1, "a"), (2, None)], "id long, v string"))
    assert rows(integrity.verified(df)) == [(1, "a"), (2, None)]
    with pytest.raises(Exception, match="row checksum mismatch"):
        integrity.verified(df.withColumn("v", F.lit("b"))).collect()


def test_shards_and_plans(spark):
    df = spark.createDataFrame([(f"k{i}", i) for i in range(100)], "k string, v long")
    shards = placement.Shards(df, "k", 8)
    shards.put(spark.createDataFrame([("k1", -1), ("new", 0)], "k string, v long"))
    keys = spark.createDataFrame([("k1",), ("absent",), ("k1",)], "k string")
    assert rows(shards.get(keys)) == [("k1", -1)]
    assert rows(shards.delete(keys)) == [("k1", -1)] and shards.get(keys).isEmpty()
    sizes = shards.sizes().collect()
    assert len(sizes) == 8 and sum(r.n for r in sizes) == 100
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        assert placement.join_settings(spark, broadcast_mb=16)["spark.sql.autoBroadcastJoinThreshold"] == "16MB" == spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        assert any("HashAggregate" in line for line in placement.explained(df.groupBy("k").count()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.join.preferSortMergeJoin")


def test_commands_applied_twice_change_nothing(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    log = spark.createDataFrame([(1, "put", 1, "x"), (2, "delete", 2, None), (3, "put", 2, "y"), (4, "noop", 1, None), (5, "put", 1, "late")], "index long, kind string, id long, v string")
    once = temporal.apply_commands(table, log, "id", 0, 4)
    assert rows(once) == [(1, "x"), (2, "y")] == rows(temporal.apply_commands(once, log, "id", 0, 4))
    assert rows(temporal.apply_commands(once, log, "id", 4, 4)) == rows(once)


def test_statements_commit_what_changed(spark, store):
    big = spark.range(1000).select("id", F.concat(F.lit("v"), F.col("id").cast("string")).alias("v"))
    store.create("t", big, "id")
    store.commit("load")
    folder = lambda s=store: s.manifest(s.head())["tables"]["t"]
    first = folder()["path"]
    sql.run(store, "UPDATE t SET v = 'x' WHERE id = 5")
    sql.run(store, "DELETE FROM t WHERE id IN (6, 7)")
    sql.run(store, "INSERT INTO t VALUES (5, 'y'), (2000, 'z')")
    a = store.commit("three statements")
    assert folder()["path"] == first and [layer["rows"] for layer in folder()["layers"]] == [1, 2, 2]
    assert rows(store.table("t").where("id IN (4, 5, 6, 7, 8, 2000)")) == [(4, "v4"), (5, "y"), (8, "v8"), (2000, "z")]
    assert rows(store.change_feed(a).select("key", "kind")) == [("2000", "added"), ("5", "modified"), ("6", "removed"), ("7", "removed")]
    assert not store._read(folder()).join(big, "id", "left_anti").where("id < 1000").count()
    # the same rows written whole have the same root
    other = Store(spark, scratch(spark, "store"))
    other.create("t", store.table("t"), "id")
    assert other.manifest(other.commit("whole"))["root"] == store.manifest(a)["root"]
    # nothing touched: no layer; back to what it was: the first root
    sql.run(store, "DELETE FROM t WHERE id = -1")
    assert store.manifest(store.commit("none"))["root"] == store.manifest(a)["root"] and len(folder()["layers"]) == 3
    sql.run(store, "INSERT INTO t VALUES (5, 'v5'), (6, 'v6'), (7, 'v7')")
    sql.run(store, "DELETE FROM t WHERE id = 2000")
    back = store.commit("back")
    assert store.manifest(back)["root"] == next(m["root"] for m in store.chain() if m["message"] == "load")
    assert store.change_feed(back).count() == 4
    # many or large layers: written whole
    sql.run(store, "UPDATE t SET v = upper(v)")
    store.commit("all")
    assert folder()["path"] != first and not folder().get("layers") and store.table("t").where("v LIKE 'V%'").count() == 1000


def test_merges_and_rollbacks_of_layers(spark, store):
    store.create("t", spark.range(100).withColumn("n", F.lit(0)), "id")
    store.commit("load")
    store.create_branch("side")
    sql.run(store, "UPDATE t SET n = 1 WHERE id = 1")
    store.commit("main")
    store.checkout("side")
    sql.run(store, "UPDATE t SET n = 2 WHERE id = 2")
    sql.run(store, "DELETE FROM t WHERE id = 3")
    store.commit("side")
    store.checkout("main")
    sql.run(store, "SELECT vc_merge_three_way('side')")
    assert rows(store.table("t").where("id < 5")) == [(0, 0), (1, 1), (2, 2), (4, 0)]
    sql.run(store, "UPDATE t SET n = 3 WHERE id = 4")
    sql.run(store, "BEGIN")
    sql.run(store, "DELETE FROM t")
    sql.run(store, "ROLLBACK")
    store.commit("four")
    assert store.table("t").count() == 99 and len(store.manifest(store.head())["tables"]["t"]["layers"]) == 3
    store.create("twice", spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, v string"))
    store.commit("not unique")
    sql.run(store, "DELETE FROM twice WHERE v = 'a'")
    with pytest.raises(ValueError, match="not unique"):
        store.commit("refused")
