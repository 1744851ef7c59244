"""Exact dedup by a tree-merge of sorted digest runs, in DataFrame operations only.

Each scan task leaves one run: its rows' digests in sorted order, one entry for each digest. The
order of digests is cut into ranges, so that a merge of large runs is many tasks. Runs then meet
in binomial rounds, 2**BITS neighbours at a time: the task of a range and a group of runs gets
their entries, brings them in order and streams through them, one entry out for each digest with
the count and the identifier that survives; no hash table is built. The winners go back down the
same tree, so no join sees more rows of one key than one run holds, whatever share of the table a
group of copies takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import FEW_KEYS, LOWER, UPPER, ascii_lower, dropped, staged, table

#: Runs that meet in a merge, as a power of two, and entries of a range of a run at most, about.
BITS, RANGE_ROWS = 4, 1_000_000


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256))


def digested(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.select(docs[id_col].alias("id"), text_digest(text).alias("digest"), F.octet_length(text).alias("n_bytes"))


def merged(entries: DataFrame, key: list[str], best_first: Column, label: str) -> DataFrame:
    """One entry for each digest of each run and range: an exchange, a sort and a pass in that order."""
    parts = entries.repartition("span", "run")
    alike = Window.partitionBy("span", "run", *key)
    nth = F.row_number().over(alike.orderBy(best_first))
    passed = parts.withColumns({"_n": nth, "group_size": F.sum("group_size").over(alike)})
    return staged(passed.where("_n = 1").drop("_n"), label)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", bits: int = BITS) -> DataFrame:
    """(id, digest, n_bytes, keep_id, group_size), one row per input row.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, and very long
    texts are digested whole. A merge verifies equality by SHA-256 and length together. ``keep``
    is "max" or "min" of the ids. Null ids lose against any other; a group of null ids only keeps
    null. Rows that repeat an id are rows of their own in ``group_size``, and ties of ids in a
    group have one ``keep_id``. Other columns of ``docs``, whatever their names, are not looked
    at. An empty table gives an empty result.
    """
    best = {"max": F.max, "min": F.min}[keep]
    best_first = {"max": F.desc_nulls_last, "min": F.asc_nulls_last}[keep]("keep_id")
    spark, key = docs.sparkSession, ["digest", "n_bytes"]
    rows = digested(docs, id_col, text_col).withColumn("run", F.spark_partition_id())
    runs = staged(rows.sortWithinPartitions("digest"), "digest-runs")
    last, n = runs.agg(F.max("run"), F.count(F.lit(1))).first()
    spans = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // RANGE_ROWS).bit_length()
    span = F.shiftright(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), 32 - spans).cast("int")
    entries = runs.select(span.alias("span"), "run", *key, F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    levels = [staged(entries.groupBy("span", "run", *key).agg(best("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")), "digest-entries")]
    while (last or 0) >> bits * (len(levels) - 1):
        levels.append(merged(levels[-1].withColumn("run", F.shiftright("run", bits)), key, best_first, "digest-merge"))
    won = levels.pop()
    for level in reversed(levels):
        below = level.select("span", *key, F.col("run").alias("own"), F.shiftright("run", bits).alias("run"))
        won = below.join(won, ["span", "run", *key]).select("span", F.col("own").alias("run"), *key, "keep_id", "group_size")
    return runs.join(won.drop("span"), [*key, "run"]).select("id", "digest", "n_bytes", "keep_id", "group_size")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were; of rows equal in id and text, the one with the least hash.

    Only ids and digests of the rows that go meet the table again: few of them are broadcast, and
    then no row of the table moves.
    """
    found = staged(exact_dedup(docs, id_col, text_col), "digest-groups")
    loses = ~F.col("id").eqNullSafe(F.col("keep_id"))
    many = found.groupBy("id", "digest").agg(F.count(F.lit(1)).alias("n"), F.first("keep_id").alias("keep_id")).where(loses | (F.col("n") > 1))
    gone = staged(many.select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), loses.alias("_loses")), "digest-losers")
    n = gone.count()
    few = lambda df: F.broadcast(df) if n <= FEW_KEYS // 8 else df
    same = docs[id_col].eqNullSafe(F.col("_id")) & (text_digest(docs[text_col]) == F.col("_digest"))
    stay = docs.join(few(gone.drop("_loses")), same, "left_anti")
    dropped(found)
    if gone.where("NOT _loses").isEmpty():  # no row repeats id and text
        return stay
    again = docs.join(few(gone.where("NOT _loses")), same).select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), "_id", "_digest")
    first = again.groupBy("_id", "_digest").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return stay.unionByName(first.select("row.*"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, keep_id, group_size, kept, text_sha256; the largest doc_id of equal texts stays."""
    out = exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, d.text_sha256
FROM d JOIN g ON d.text_sha256 = g.text_sha256
"""
