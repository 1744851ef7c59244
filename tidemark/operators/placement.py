"""Hash and range placement."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

SPLIT_BYTES = 128 << 20


def stable_shard(key: Column, n: int) -> Column:
    return F.pmod(F.hash(key), F.lit(n))


@F.pandas_udf(LongType())
def murmur3(keys: pd.Series) -> pd.Series:
    """MurmurHash3 x86 32 bits, seed 0, of each text's UTF-8 (null: empty); for shard numbers that others also compute.

    All texts of a batch are hashed together, four bytes of each at a time, the longest first.
    """
    data = [("" if k is None else k).encode() for k in keys]
    lengths = np.array([len(d) for d in data], dtype=np.int64)
    words = np.frombuffer(b"".join(d + b"\0" * (-len(d) % 4) for d in data), dtype="<u4")
    starts = np.cumsum(-(-lengths // 4)) - -(-lengths // 4)
    rot = lambda x, r: x << np.uint32(r) | x >> np.uint32(32 - r)
    scramble = lambda k: rot(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    h, whole = np.zeros(len(data), dtype=np.uint32), lengths // 4
    order = np.argsort(-whole, kind="stable")
    left = np.searchsorted(-whole[order], -np.arange(whole.max(initial=0)), side="left")  # texts with a word more
    for j, n in enumerate(left.tolist()):
        at = order[:n]
        h[at] = rot(h[at] ^ scramble(words[starts[at] + j]), 13) * np.uint32(5) + np.uint32(0xE6546B64)
    at = np.flatnonzero(lengths % 4)
    h[at] ^= scramble(words[starts[at] + whole[at]])
    h ^= lengths.astype(np.uint32)
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> np.uint32(shift)) * np.uint32(by)
    return pd.Series((h ^ h >> np.uint32(16)).astype(np.int64))


def route(df: DataFrame, key: str, bounds: list[tuple[int, object, object]]) -> DataFrame:
    """Rows with the ``range_id`` of the range [start, end) of their key; the ranges are a list, so it is one expression."""
    col, found = F.col(key), F.lit(None).cast("int")
    for i, start, end in reversed(bounds):
        inside = F.lit(True)
        if start is not None:
            inside = inside & (col >= F.lit(start))
        if end is not None:
            inside = inside & (col < F.lit(end))
        found = F.when(inside, F.lit(i)).otherwise(found)
    return df.withColumn("range_id", found)


def split_candidates(ranges: DataFrame, limit: int = SPLIT_BYTES) -> DataFrame:
    return ranges.where(F.col("size_bytes") > limit)


def split(ranges: DataFrame, limit: int = SPLIT_BYTES) -> DataFrame:
    """Ranges above the limit as two halves in size."""
    halves = F.when(F.col("size_bytes") > limit, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(-1)))
    out = ranges.withColumn("half", F.explode(halves))
    whole = F.floor(F.col("size_bytes") / 2)
    return out.withColumn("size_bytes", F.when(F.col("half") == 0, whole).when(F.col("half") == 1, F.col("size_bytes") - whole).otherwise(F.col("size_bytes")))


def merge_adjacent(ranges: DataFrame, limit: int) -> DataFrame:
    """Neighbouring ranges, two by two in key order, as one where both together stay within the limit; the smaller id wins."""
    pair = F.floor((F.row_number().over(Window.orderBy("start_key")) - 1) / 2)
    total = F.sum("size_bytes").over(Window.partitionBy("_pair"))
    out = ranges.withColumn("_pair", pair).withColumn("_own", F.when(total <= limit, -1).otherwise(F.col("range_id")))
    return out.groupBy("_pair", "_own").agg(F.min("range_id").alias("range_id"), F.min("start_key").alias("start_key"), F.sum("size_bytes").alias("size_bytes")).drop("_pair", "_own")


def rebalance(replicas: DataFrame, nodes: DataFrame, factor: int) -> DataFrame:
    """(range_id, node): for ranges with too few live replicas the smallest live nodes that hold none."""
    live = replicas.join(nodes, "node", "left_semi")
    missing = replicas.select("range_id").distinct().join(live.groupBy("range_id").count(), "range_id", "left").select("range_id", (F.lit(factor) - F.coalesce("count", F.lit(0))).alias("need")).where("need > 0")
    free = missing.join(nodes, F.lit(True)).join(live, ["range_id", "node"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("range_id").orderBy("node"))
    return free.withColumn("_n", nth).where("_n <= need").select("range_id", "node")


class Shards:
    """Rows by key in ``n`` shards; which shard a key has follows from the hash of its text alone.

    Reads and writes are on tables of keys and rows; each is a DataFrame, planned when it is used.
    """

    def __init__(self, rows: DataFrame, key: str, n: int):
        self.key, self.n = key, n
        self.rows = self._placed(rows)

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("shard", F.pmod(murmur3(F.col(self.key).cast("string")), F.lit(self.n)).cast("int"))

    def put(self, new: DataFrame) -> None:
        """Rows with known keys are replaced; a key is given once."""
        self.rows = self.rows.join(new.select(self.key), self.key, "left_anti").unionByName(self._placed(new))

    def get(self, keys: DataFrame) -> DataFrame:
        return self.rows.join(keys.select(self.key).distinct(), self.key, "left_semi").drop("shard")

    def delete(self, keys: DataFrame) -> DataFrame:
        """The rows that go."""
        gone = self.get(keys)
        self.rows = self.rows.join(keys.select(self.key), self.key, "left_anti")
        return gone

    def sizes(self) -> DataFrame:
        """(shard, n) of every shard, empty ones too."""
        every = self.rows.sparkSession.range(self.n).select(F.col("id").cast("int").alias("shard"))
        return every.join(self.rows.groupBy("shard").count(), "shard", "left").select("shard", F.coalesce("count", F.lit(0)).alias("n"))


def scatter_gather(df: DataFrame, key: str, bounds: list[tuple[int, object, object]], *aggregates: Column) -> DataFrame:
    """The aggregates of each range's rows, in the order of range ids; ranges without rows are left out."""
    return route(df, key, bounds).where("range_id IS NOT NULL").groupBy("range_id").agg(*aggregates).orderBy("range_id")


def join_settings(spark: SparkSession, shuffle_join: bool = True, broadcast_mb: int = 32, partitions: int | None = None) -> dict[str, str]:
    """Set how joins are planned: up to which size a side is broadcast, and whether larger ones are sorted or hashed. What was set."""
    chosen = {
        "spark.sql.autoBroadcastJoinThreshold": f"{broadcast_mb}MB",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": f"{broadcast_mb}MB",
        "spark.sql.join.preferSortMergeJoin": str(shuffle_join).lower(),
    }
    if partitions:
        chosen["spark.sql.shuffle.partitions"] = str(partitions)
    for k, v in chosen.items():
        spark.conf.set(k, v)
    return chosen


def explained(df: DataFrame) -> list[str]:
    """The physical plan of a query, line by line, with its exchanges: what runs where between them."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).splitlines()
