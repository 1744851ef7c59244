"""Row-level differences of two versions of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_hash(df: DataFrame, columns: list[str] | None = None) -> Column:
    """SHA-256 of the row, or of some columns, as JSON with nulls written out, so null and empty text differ."""
    return F.sha2(F.to_json(F.struct(*[df[c] for c in columns or df.columns]), {"ignoreNullFields": "false"}), 256)


def diff_rows(before: DataFrame, after: DataFrame, key: str, compared: list[str] | None = None) -> DataFrame:
    """(key, kind, before_hash, after_hash) of rows added, removed or modified; keys are unique and not null.

    With ``compared`` columns, a row is modified when one of these differs, and hashes are of these.
    """
    a = before.select(before[key].cast("string").alias("key"), row_hash(before, compared).alias("before_hash"))
    b = after.select(after[key].cast("string").alias("key"), row_hash(after, compared).alias("after_hash"))
    kind = F.when(F.col("before_hash").isNull(), "added").when(F.col("after_hash").isNull(), "removed").otherwise("modified")
    return a.join(b, "key", "full_outer").where(~F.col("before_hash").eqNullSafe(F.col("after_hash"))).withColumn("kind", kind)


def seal_of(df: DataFrame) -> tuple[int, str]:
    """(rows, sum of 60 bits of each row's hash): alike for equal rows in any order."""
    part = F.conv(F.substring(row_hash(df), 1, 15), 16, 10).cast("decimal(38,0)")
    n, total = df.agg(F.count(F.lit(1)), F.sum(part)).first()
    return n, str(total)


def delta_merge(old: DataFrame, new: DataFrame, touched: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of the keys of ``touched`` (key, as text) read anew: masked out, then appended from ``new``."""
    kept = old.join(touched, old[key].cast("string") == touched["key"], "left_anti")
    return kept.unionByName(new.join(touched, new[key].cast("string") == touched["key"], "left_semi"))
