"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

Targets come from the weights with a cap per source (water-filling). The whole mix is cut into
blocks of equally many words; the highest quotients target / (2k + 1) get the blocks, first
among sources, then among the shards of each source. A shard lays its documents in seeded order,
repeats that line as often as allowed, and gives the first blocks up to its quota.

Only the rows (id, source, size) move after the one pass over the texts. A source of any size
is spread over its shards; the tables of sources and of shards are sums, not rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import BLANK, staged, table

#: Buckets by which a source is cut into shards; a power of two.
BUCKETS = 8192


def n_words(text: Column) -> Column:
    """Words of ASCII-blank-separated text, null 0: each word becomes one letter, then blanks go."""
    marks = F.translate(F.regexp_replace(text, BLANK, "x"), " \t\n\x0b\x0c\r", "")
    return F.coalesce(F.char_length(marks), F.lit(0)).cast("long")


def sainte_lague(df: DataFrame, within: list[str], order: list[str], share: str, seats: str, out: str) -> DataFrame:
    """Adds ``out``: of the ``seats`` of each ``within`` group, those that rows with ``share`` win.

    The k-th seat of a row has the quotient share / (2k - 1). The divisor that leaves at most one
    seat a row open is known from the sums, so most seats need no comparison; quotients between
    it and the divisor that certainly gives all of them compete, about two a row.
    """
    every = Window.partitionBy(*within)
    total, rows = F.sum(share).over(every).cast("double"), F.count(F.lit(1)).over(every)
    sure, reach = F.col(seats) - rows / 2.0 - 1, F.col(seats) + rows / 2.0 + 1
    seats_at = lambda x: F.when(total > 0, F.floor(F.col(share) * F.greatest(x, F.lit(0.0)) / total + 0.5)).otherwise(0).cast("long")
    held = df.withColumns({"_low": seats_at(sure), "_high": seats_at(reach)})
    open_ = F.col(seats) - F.sum("_low").over(every)
    held = held.withColumn("_open", open_)
    rivals = held.withColumn("_k", F.explode(F.sequence("_low", F.greatest("_low", "_high"))))
    rank = F.row_number().over(Window.partitionBy(*within).orderBy((F.col(share) / (2 * F.col("_k") + 1)).desc(), *order, "_k"))
    won = rivals.withColumn("_won", (rank <= F.col("_open")).cast("long"))
    return won.groupBy(*df.columns, "_low").agg(F.sum("_won").alias("_won")).withColumn(out, F.col("_low") + F.col("_won")).drop("_low", "_won")


def source_targets(sizes: DataFrame, weights: Sequence[float], ratio: float, repeats: int) -> DataFrame:
    """(source, source_size) with sid (order by code point, null last), target and all (sum of targets).

    The level of the water is found in one pass over the sources sorted by cap / weight: the first
    source that its cap does not stop sets it for all behind it.
    """
    every = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("sid", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("sid"), F.lit(len(weights))) + 1))
    s = s.withColumn("cap", repeats * F.col("source_size"))
    s = s.withColumn("all", F.least(ratio * F.sum("source_size").over(every), F.sum("cap").over(every).cast("double")))
    ahead = Window.orderBy(F.col("cap") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(ahead), F.lit(0.0))
    s = s.withColumn("level", (F.col("all") - F.coalesce(F.sum("cap").over(ahead), F.lit(0))) / rest)
    s = s.withColumn("stopped", F.col("cap") / F.col("weight") < F.col("level"))
    water = F.min(F.when(~F.col("stopped"), F.struct(F.col("cap") / F.col("weight"), "sid", "level"))).over(every)["level"]
    target = F.when(F.col("stopped"), F.col("cap").cast("double")).otherwise(F.col("weight") * water)
    return s.withColumn("target", target).select("source", "source_size", "sid", "target", "all")


def mix_sources(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), ratio: float = 1.5, repeats: int = 2, block_words: int = 16, seed: str = "mix", shard_words: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """(id, source, size, source_size, target, shard, quota, taken) for each row of ``docs``.

    ``size`` is the number of words, null 0. Sources in code point order, null last (a source like
    any other), take the ``weights`` in turn and share ``ratio`` times all words, none above
    ``repeats`` times its own. ``quota`` is the shard's number of blocks, ``taken`` the words that
    the mix takes of the row, repeats counted, ``repeats * size`` at most. The seeded order is that
    of md5(seed|id), then id, then size, so reruns agree; rows equal in all of them are
    interchangeable. Empty texts take nothing; an empty table gives an empty result.
    """
    name = F.concat(F.lit(f"{seed}|"), F.coalesce(docs[id_col].cast("string"), F.lit("")))
    h = F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long")
    light = staged(docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"), n_words(docs[text_col]).alias("size"), h.alias("h")).withColumn("bucket", F.pmod("h", F.lit(BUCKETS))), "mix-sizes")
    cells = staged(light.groupBy("source", "bucket").agg(F.sum("size").alias("cell_size")), "mix-cells")
    targets = source_targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights, ratio, repeats)
    blocks = targets.withColumn("blocks", F.floor(F.col("all") / block_words + 0.5).cast("long"))
    quotas = staged(sainte_lague(blocks, [], ["sid"], "target", "blocks", "source_quota"), "mix-quotas")
    shards = F.greatest(F.lit(1), F.least(F.lit(BUCKETS), F.ceil(F.col("source_size") / shard_words)))
    placed = cells.join(quotas, cells["source"].eqNullSafe(quotas["source"])).drop(quotas["source"])
    placed = placed.withColumn("shard", F.floor(F.col("bucket") * shards / BUCKETS).cast("long"))
    sums = placed.groupBy("sid", "shard", "source_quota").agg(F.sum("cell_size").alias("shard_size"))
    won = sainte_lague(sums, ["sid"], ["shard"], "shard_size", "source_quota", "quota").drop("source_quota")
    plan = placed.join(won, ["sid", "shard"]).select("source", "bucket", "sid", "shard", "source_size", "target", "shard_size", "quota")
    rows = light.join(plan, light["source"].eqNullSafe(plan["source"]) & (light["bucket"] == plan["bucket"])).drop(plan["source"], plan["bucket"])
    line = Window.partitionBy("sid", "shard").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("size").over(line), F.lit(0))
    words = F.least(F.col("quota") * block_words, repeats * F.col("shard_size"))
    rows = rows.withColumns({"_start": start, "_words": words, "_turns": F.when(F.col("shard_size") > 0, F.floor(words / F.col("shard_size"))).otherwise(0).cast("long")})
    left = F.col("_words") - F.col("_turns") * F.col("shard_size") - F.col("_start")
    taken = F.col("_turns") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return rows.select("id", "source", "size", "source_size", "target", "shard", "quota", taken.cast("long").alias("taken"))


def repeat_rows(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as its taken words go into its size, rounded.

    Rows come and go whole; only the two ends of a shard's line round. Ids must be unique, or
    rows that share one are taken alike.
    """
    plan = mix_sources(docs, id_col=id_col, **options).where("taken > 0").groupBy("id").agg(F.max(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int").alias("_turns")).where("_turns > 0")
    mine = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("id"))
    both = mine.join(plan, mine["id"].eqNullSafe(plan["id"]))
    return both.withColumn("_turn", F.explode(F.sequence(F.lit(1), F.col("_turns")))).select("row.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, size, source_size, target and taken of the mix by weights 3, 1, 2."""
    out = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
