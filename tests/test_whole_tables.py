"""Queries over whole tables against brute force."""

import datetime
import hashlib

from tidemark import catalogue
from tidemark.operators import integrity, stats
from tidemark.plans import relational

DAY = datetime.datetime(2024, 1, 1)


def test_join_asof_takes_every_event(spark, tmp_path):
    at = lambda n: DAY + datetime.timedelta(days=n)
    events = [(i, at(i % 7)) for i in range(230)]
    orders = [(k, k % 50, at(k % 6)) for k in range(400)] + [(900, 3, at(1)), (901, 3, at(1)), (902, None, at(0))]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    want = {}
    for i, ts in events:
        if found := [(d, k) for k, c, d in orders if c == i % 100 and d <= ts]:
            want[i] = max(found)[1]
    assert any(i % 10 for i in want)
    rows = catalogue.QUERIES["join_asof"](spark, str(tmp_path)).collect()
    assert len(rows) == len(want) and {r.event_id: r.o_orderkey for r in rows} == want


def test_pk_text_order_takes_every_key(spark, tmp_path):
    keys = [*{*range(0, 30000, 7), -5, -10, 2000, 10**12}]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    want = {k: n + 1 for n, k in enumerate(sorted(keys, key=str))}
    rows = catalogue.QUERIES["pk_text_order"](spark, str(tmp_path)).collect()
    assert len(rows) == len(want) and {r.o_orderkey: r.nth for r in rows} == want


def test_leaves_and_segments_do_not_depend_on_partitions(spark):
    docs = spark.range(3000).selectExpr("id AS k", "concat('n', id * 7 % 1000) AS v").repartition(7)
    old, seen = spark.conf.get("spark.sql.shuffle.partitions"), set()
    rows = sorted((f"t\0{k}".encode(), f"{k}\tn{k * 7 % 1000}".encode()) for k in range(3000))
    level = []
    size = lambda b: len(b).to_bytes(4, "little") + b
    ends = lambda k, v: hashlib.sha256(k + v).digest()[0] & 3 == 0
    held = []
    for k, v in rows:
        held.append((k, v))
        if ends(k, v):
            level.append((held[0][0], hashlib.sha256(b"leaf" + b"".join(size(a) + size(b) for a, b in held)).digest()))
            held = []
    if held:
        level.append((held[0][0], hashlib.sha256(b"leaf" + b"".join(size(a) + size(b) for a, b in held)).digest()))
    n_leaves = len(level)
    while len(level) > 1:
        up, held = [], []
        for k, h in level:
            held.append((k, h))
            if ends(k, h) and len(held) > 1:
                up.append((held[0][0], hashlib.sha256(b"internal" + b"".join(size(a) + b for a, b in held)).digest()))
                held = []
        if held:
            up.append((held[0][0], hashlib.sha256(b"internal" + b"".join(size(a) + b for a, b in held)).digest()))
        level = up
    try:
        for n in ("2", "8", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found = integrity.leaves(integrity.entries(docs, "t", "k"))
            assert found.count() == n_leaves
            seen.add(integrity.content_root(found))
            sizes = [r["count"] for r in stats.segments(docs, "k").groupBy("segment").count().orderBy("segment").collect()]
            assert sizes == [1024, 1024, 952]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert seen == {level[0][1].hex()}
    assert integrity.content_root(found.where("false")) is None


def test_longer_digests_are_those_of_the_names(spark):
    """DuckDB has no such functions, so the query has no SQL."""
    names = dict(spark.read.parquet("/root/testdata/sf0.001/customer.parquet").select("c_custkey", "c_name").collect())
    for r in relational.QUERIES["fn_sha_more"](spark, "/root/testdata/sf0.001").collect():
        data = names.pop(r.c_custkey).encode()
        assert (r.s224, r.s384, r.s512) == (hashlib.sha224(data).hexdigest(), hashlib.sha384(data).hexdigest(), hashlib.sha512(data).hexdigest())
    assert not names


def test_join_lateral_keeps_its_order_over_spills(spark, tmp_path):
    orders = [(k, k % 5, k * 7919 % 101 / 4) for k in range(4000)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(7).selectExpr("id AS c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    for t in {*relational.TABLES} - {"orders", "customer"}:
        spark.range(1).write.parquet(f"{tmp_path}/{t}.parquet")
    want = [(c, k) for c in range(5) for _, k in sorted((-p, k) for k, of, p in orders if of == c)[:2]]
    conf, name = spark._jvm.org.apache.spark.SparkEnv.get().conf(), "spark.shuffle.spill.numElementsForceSpillThreshold"
    conf.set(name, "50")
    try:
        found = catalogue.QUERIES["join_lateral"](spark, str(tmp_path)).collect()
    finally:
        conf.remove(name)
    assert sorted(map(tuple, found)) == sorted(want)
