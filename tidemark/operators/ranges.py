"""Positions in key order without a task that orders the whole table.

Keys are dealt to ranges by comparison with bounds of a sample, so a row's range is a function of
its key alone, however often and wherever it is computed. What runs over a range's end is carried
by one row for each range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Keys of the sample from which bounds are taken, about.
SAMPLE = 10_000


def ranged(df: DataFrame, key: str, out: str = "_part") -> DataFrame:
    """``df`` with the number of its key's range; null keys are in the first."""
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = max(1, df.count() // SAMPLE)
    some = df.where(F.col(key).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(every)) == 0)).select(key).orderBy(key)
    sample = [r[0] for r in some.collect()]
    bounds = list(dict.fromkeys(sample[len(sample) * i // spread] for i in range(1, spread))) if sample else []
    kind = df.schema[key].dataType.simpleString()
    array = F.array(*map(F.lit, bounds)).cast(f"array<{kind}>")
    return df.withColumn(out, F.coalesce(F.size(F.filter(array, lambda b: b <= F.col(key))), F.lit(0)))


def before(parts: DataFrame, sums: DataFrame, value: str, out: str) -> DataFrame:
    """``parts`` with the sum of ``value`` of ``sums`` (_part, value) over the ranges before its own; there are as many sums as ranges."""
    found, total = [], 0
    for part, n in sorted(tuple(r) for r in sums.select("_part", value).collect()):
        found.append((part, total))
        total += n
    return parts.join(F.broadcast(parts.sparkSession.createDataFrame(found, f"_part int, {out} long")), "_part")


def positions(df: DataFrame, key: str, out: str) -> DataFrame:
    """``df`` with the position of each row in key order, from 0, nulls first; rows of one key are in the order of their hash."""
    parts = ranged(df, key)
    placed = before(parts, parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")), "_n", "_shift")
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(F.col(key).asc_nulls_first(), F.xxhash64(*[F.col(c) for c in df.columns])))
    return placed.withColumn(out, (nth + F.col("_shift") - 1).cast("long")).drop("_part", "_shift")
