"""Zone maps, segments, pruning, unique ratios and bloom filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranges import positions

SEGMENT_ROWS = 1024
BLOOM_BITS = 256


def zone_map(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: least and largest value as doubles, nulls left out and counted."""
    parts = [F.struct(F.lit(c).alias("column"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"), F.count_if(F.col(c).isNull()).alias("nulls")) for c in columns]
    return df.agg(F.array(*parts).alias("z")).select(F.inline("z"))


def segments(df: DataFrame, key: str, rows: int = SEGMENT_ROWS) -> DataFrame:
    """Rows with ``segment``: positions in key order, ``rows`` at a time."""
    return positions(df, key, "_nth").withColumn("segment", F.floor(F.col("_nth") / rows)).drop("_nth")


def segment_zones(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy("segment").agg(F.min(column).alias("min"), F.max(column).alias("max"), F.count_if(F.col(column).isNull()).alias("nulls"), F.count(F.lit(1)).alias("rows"))


def disproved(low: Column, high: Column, op: str, value) -> Column:
    """Whether no value between ``low`` and ``high`` can satisfy ``op value``; unknown bounds disprove nothing."""
    return F.coalesce({">": high <= value, ">=": high < value, "<": low >= value, "<=": low > value, "=": (low > value) | (high < value)}[op], F.lit(False))


def prune(zones: DataFrame, op: str, value) -> DataFrame:
    """(kept, total) segments for a comparison."""
    return zones.agg(F.count_if(~disproved(F.col("min"), F.col("max"), op, value)).alias("kept"), F.count(F.lit(1)).alias("total"))


def unique_ratio(df: DataFrame, columns: list[str]) -> DataFrame:
    parts = [F.struct(F.lit(c).alias("column"), F.coalesce(F.count_distinct(c) / F.nullif(F.count(c), F.lit(0)), F.lit(0.0)).alias("ratio")) for c in columns]
    return df.agg(F.array(*parts).alias("r")).select(F.inline("r"))


def probes(value: Column) -> Column:
    """Two bit numbers of a text, from the first and the second four bytes of its SHA-256."""
    digest = F.sha2(value.cast("string"), 256)
    return F.array(*[F.pmod(F.conv(F.substring(digest, a, 8), 16, 10).cast("long"), F.lit(BLOOM_BITS)) for a in (1, 9)])


def bloom(df: DataFrame, group: str, column: str) -> DataFrame:
    """(group, bits): the distinct bit numbers set by the values of a block."""
    return df.where(F.col(column).isNotNull()).select(group, F.explode(probes(F.col(column))).alias("bit")).groupBy(group).agg(F.sort_array(F.collect_set("bit")).alias("bits"))


def may_hold(blooms: DataFrame, value: str) -> DataFrame:
    """Blocks that may hold ``value``; never leaves out one that does."""
    wanted = probes(F.lit(value))
    return blooms.where(F.array_contains("bits", wanted[0]) & F.array_contains("bits", wanted[1]))
