"""Inserts, upserts, updates and deletes as functions from a table's rows to its new rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert(df: DataFrame, new: DataFrame, key: str, overwrite: bool = True) -> DataFrame:
    """``new`` rows take the place of rows with their keys; without ``overwrite`` a key met twice is an error."""
    if not overwrite and not df.join(new, key, "left_semi").isEmpty():
        raise ValueError("a key is there already")
    return df.join(new.select(key), key, "left_anti").select(df.columns).unionByName(new, allowMissingColumns=True)


def upsert(df: DataFrame, new: DataFrame, key: str, on_conflict: str = "nothing", sets: dict[str, str | Column] | None = None, target: str | None = None) -> DataFrame:
    """New keys are inserted; rows with a known key stay, or have ``sets`` applied.

    A value of ``sets`` is a column name of the new row, or an expression of the columns of
    ``new`` under ``excluded_``. A conflict ``target``, if one is named, must be the key.
    """
    if target not in (None, key):
        raise ValueError(f"the conflict target {target} is not the key {key}")
    fresh = new.join(df.select(key), key, "left_anti")
    if on_conflict == "nothing":
        return df.unionByName(fresh, allowMissingColumns=True)
    other = new.select(new[key], F.lit(True).alias("_met"), *[new[c].alias(f"excluded_{c}") for c in new.columns if c != key])
    both = df.join(other, key, "left")
    value = lambda v: F.col(f"excluded_{v}") if isinstance(v, str) else v
    kept = both.select(*[F.when(F.col("_met"), value(sets[c])).otherwise(F.col(c)).alias(c) if c in (sets or {}) else F.col(c) for c in df.columns])
    return kept.unionByName(fresh, allowMissingColumns=True)


def update(df: DataFrame, sets: dict[str, Column], where: Column | None = None, key: str | None = None) -> DataFrame:
    """Assign where the condition holds; a null condition is no match. Keys that meet keep the last row in the old key's text order."""
    hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    out = df.select(*[F.when(hit, sets[c]).otherwise(F.col(c)).alias(c) if c in sets else F.col(c) for c in df.columns], *([F.col(key).cast("string").alias("_old")] if key in sets else []))
    if key not in sets:
        return out
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.col("_old").desc()))
    return out.withColumn("_n", last).where("_n = 1").drop("_n", "_old")


def delete(df: DataFrame, where: Column | None = None) -> DataFrame:
    """Rows for which the condition is not true; without one, none."""
    return df.where(F.lit(False) if where is None else ~F.coalesce(where, F.lit(False)))


def ingest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """All columns as text; of rows with one key the second gets the suffix #1, the third #2, and so on."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    text = df.withColumn("_nth", nth).withColumns({c: F.col(c).cast("string") for c in df.columns})
    return text.withColumn(key, F.when(F.col("_nth") > 0, F.concat(F.col(key), F.lit("#"), F.col("_nth"))).otherwise(F.col(key))).drop("_nth")


def once(done: DataFrame, requests: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Requests to carry out: the first of each idempotence key that was not done before."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return requests.withColumn("_n", nth).where("_n = 1").drop("_n").join(done.select(key), key, "left_anti")
