"""Row checksums, mirrors, and content-defined leaf chunks of a keyed table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.diff import row_hash
from tidemark.operators.ranges import before, positions, ranged
from tidemark.plans.paths import written

#: A leaf ends after an entry whose digest ends its first byte in so many zero bits: four entries on average.
CUT_BITS = 2


def sealed(df: DataFrame) -> DataFrame:
    return df.withColumn("row_sha256", row_hash(df))


def scrub(df: DataFrame) -> DataFrame:
    """Rows whose stored checksum is not that of their other columns."""
    return df.where(row_hash(df.drop("row_sha256")) != F.col("row_sha256"))


def verified(df: DataFrame) -> DataFrame:
    """The rows without their checksums, in one pass; a row whose stored checksum is not its own ends the query with an error."""
    own = row_hash(df.drop("row_sha256"))
    right = F.when(own.eqNullSafe(F.col("row_sha256")), True).otherwise(F.raise_error(F.concat(F.lit("row checksum mismatch: "), own)).cast("boolean"))
    return df.where(right).drop("row_sha256")


def mirrored(log: DataFrame, table: str, key: str, commit: str) -> DataFrame:
    """An append-only mirror: one row for each (table, key, commit), whichever way it is repeated."""
    name = F.sha2(F.concat_ws("\0", table, key, commit), 256)
    return log.withColumn("entry", name).dropDuplicates(["entry"])


def latest(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
    return log.withColumn("_n", nth).where("_n = 1").drop("_n")


def entries(df: DataFrame, table: str, key: str) -> DataFrame:
    """(entry_key, value): table, a zero byte and the key's text, and the row's cells as text between tabs."""
    name = F.concat(F.lit(table), F.lit("\0"), F.col(key).cast("string"))
    return df.select(name.alias("entry_key"), F.concat_ws("\t", *[F.col(c).cast("string") for c in df.columns]).alias("value"))


def sized(cell: Column) -> Column:
    """Hex of a binary cell behind its length as four bytes, the lowest first."""
    n = F.lpad(F.hex(F.octet_length(cell).cast("long")), 8, "0")
    return F.concat(*[F.substring(n, i, 2) for i in (7, 5, 3, 1)], F.hex(cell))


def ends_node(key: Column, content: Column) -> Column:
    """Whether a node ends after this entry: the first byte of the SHA-256 of both ends in so many zero bits."""
    digest = F.sha2(F.concat(key.cast("binary"), content.cast("binary")), 256)
    return F.conv(F.substring(digest, 2, 1), 16, 10).cast("int").bitwiseAND(F.lit((1 << CUT_BITS) - 1)) == 0


def numbered_by_cuts(parts: DataFrame, key: str, out: str) -> DataFrame:
    """``parts`` (with _part and cut) with the number of cuts before each row in key order."""
    placed = before(parts, parts.groupBy("_part").agg(F.sum("cut").alias("_cuts")), "_cuts", "_shift")
    own = F.coalesce(F.sum("cut").over(Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn(out, F.col("_shift") + own)


def leaves(df: DataFrame) -> DataFrame:
    """(leaf, first_key, last_key, n, leaf_hash) of (entry_key, value), keys unique: cut by content, so an edit changes its own leaf.

    The hash is SHA-256 of the tag and of each entry's key and value behind their lengths.
    """
    parts = ranged(df, "entry_key").withColumn("cut", ends_node(F.col("entry_key"), F.col("value")).cast("long"))
    placed = numbered_by_cuts(parts, "entry_key", "leaf")
    item = F.concat(sized(F.col("entry_key").cast("binary")), sized(F.col("value").cast("binary")))
    rows = placed.groupBy("leaf").agg(F.min("entry_key").alias("first_key"), F.max("entry_key").alias("last_key"), F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("entry_key", item.alias("item")))).alias("e"))
    return rows.select("leaf", "first_key", "last_key", "n", F.sha2(F.unhex(F.concat(F.hex(F.lit("leaf")), F.concat_ws("", F.col("e.item")))), 256).alias("leaf_hash"))


def parents(nodes: DataFrame) -> DataFrame:
    """(key, hash) of the level above nodes (key, hash): a node ends as a leaf does, by key and child hash, but has two children at least.

    So of neighbours that would each end a node every second does; where such a run begins is
    carried over ranges as a position.
    """
    placed = positions(nodes, "key", "at").withColumn("ends", ends_node(F.col("key"), F.unhex("hash")))
    parts = written(ranged(placed, "key"), "tree-nodes")
    open_at = F.when(~F.col("ends"), F.col("at"))
    lasts = parts.groupBy("_part").agg(F.max(open_at).alias("_open"))
    lasts = lasts.select("_part", F.max("_open").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    line = Window.partitionBy("_part").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.join(F.broadcast(lasts), "_part").withColumn("_open", F.coalesce(F.max(open_at).over(line), F.col("_carried")))
    nth = F.when(F.col("_open").isNull(), F.col("at") + 1).otherwise(F.col("at") - F.col("_open") + 1)  # even: ends
    parts = parts.withColumn("cut", (F.col("ends") & (nth % 2 == 0)).cast("long"))
    held = numbered_by_cuts(written(parts.select("_part", "key", "hash", "cut"), "tree-cuts"), "key", "node")
    item = F.concat(sized(F.col("key").cast("binary")), F.upper("hash"))
    rows = held.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("key", item.alias("item")))).alias("e"))
    return rows.select(F.element_at("e.key", 1).alias("key"), F.sha2(F.unhex(F.concat(F.hex(F.lit("internal")), F.concat_ws("", F.col("e.item")))), 256).alias("hash"))


def content_root(leaf_nodes: DataFrame) -> str | None:
    """The hash at the top of the tree over leaves (first_key, leaf_hash); none without leaves. Equal rows have equal roots."""
    level = leaf_nodes.select(F.col("first_key").alias("key"), F.col("leaf_hash").alias("hash"))
    while True:
        level = written(level, "tree-level")
        if (n := level.count()) < 2:
            return level.first()["hash"] if n else None
        level = parents(level)


def leaf_difference(before_leaves: DataFrame, after_leaves: DataFrame) -> DataFrame:
    """(side, leaf, first_key, last_key): leaves whose hash only one version has; rows elsewhere are equal."""
    one = lambda a, b, side: a.join(b.select("leaf_hash"), "leaf_hash", "left_anti").select(F.lit(side).alias("side"), "leaf", "first_key", "last_key")
    return one(before_leaves, after_leaves, "removed").unionByName(one(after_leaves, before_leaves, "added"))
