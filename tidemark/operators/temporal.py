"""Closed timestamps, quorum positions and log replay over tables of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def closed_ts(now: Column, lag: int, in_flight: Column) -> Column:
    """Up to where nothing can change: behind now by ``lag``, and before the oldest write in flight."""
    return F.least(now - lag, F.coalesce(in_flight - 1, now - lag))


def negotiate(ranges: DataFrame, now: int, bound: int) -> DataFrame:
    """(read_ts, served): the least closed timestamp of all ranges, served when known and not older than ``bound``."""
    low, known = F.min("closed"), F.bool_and(F.col("closed").isNotNull() & (F.col("closed") != 0))
    return ranges.agg(low.alias("read_ts"), F.coalesce(known & (low >= now - bound), F.lit(False)).alias("served"))


def exact_plan(ranges: DataFrame, now: int, staleness: int) -> DataFrame:
    """(read_ts, served): whether every range has closed what lies ``staleness`` back."""
    return ranges.agg(F.lit(now - staleness).alias("read_ts"), F.coalesce(F.bool_and(F.coalesce(F.col("closed") >= now - staleness, F.lit(False))), F.lit(False)).alias("served"))


def quorum_lsn(acks: DataFrame, group: str, acceptors: int) -> DataFrame:
    """(group, commit_lsn): the largest position that a majority of acceptors has flushed; null without a quorum."""
    need = acceptors // 2 + 1
    each = acks.groupBy(group, "acceptor").agg(F.max("lsn").alias("lsn"))
    return each.groupBy(group).agg(F.try_element_at(F.sort_array(F.collect_list("lsn"), asc=False), F.lit(need)).alias("commit_lsn"))


def replay_at(log: DataFrame, page: str, lsn: str, kind: str, delta: str, at: int, cutoff: int | None = None) -> DataFrame:
    """(page, image): each page's last replacement up to ``at`` and what was appended behind it, in order.

    Only the records from the last replacement on are gathered; how many there are is what
    compaction bounds. Below the ``cutoff`` of a compaction the log is gone, so reading there is an error.
    """
    if cutoff is not None and at < cutoff:
        raise ValueError(f"position {at} is below the cutoff {cutoff}")
    seen = log.where(F.col(lsn) <= at)
    base = seen.where(F.col(kind) == "replace").groupBy(page).agg(F.max(lsn).alias("_from"))
    live = seen.join(base, page, "left").where(F.col("_from").isNull() | (F.col(lsn) >= F.col("_from")))
    parts = F.sort_array(F.collect_list(F.struct(F.col(lsn).alias("l"), F.col(delta).alias("d"))))
    return live.groupBy(page).agg(F.array_join(F.transform(parts, lambda x: x["d"]), "").alias("image"))


def compact(log: DataFrame, page: str, lsn: str, kind: str, delta: str, at: int) -> DataFrame:
    """The log with all up to ``at`` replaced by one image per page at that position."""
    image = replay_at(log, page, lsn, kind, delta, at).select(F.col(page), F.lit(at).cast("long").alias(lsn), F.lit("replace").alias(kind), F.col("image").alias(delta))
    return image.unionByName(log.where(F.col(lsn) > at).select(page, lsn, kind, delta))


def lag(heads: DataFrame, written: str, applied: str, limit: int = 1024) -> DataFrame:
    behind = F.col(written) - F.col(applied)
    return heads.withColumns({"lag": behind, "rejected": behind > limit})


def follow(known: DataFrame, updates: DataFrame, group: str) -> DataFrame:
    """(group, closed): a follower's closed timestamps after updates that may come late or twice; none goes back."""
    return known.select(group, "closed").unionByName(updates.select(group, "closed")).groupBy(group).agg(F.max("closed").alias("closed"))


def read_gate(ranges: DataFrame, read_ts: int) -> DataFrame:
    """``ranges`` with ``admitted``: whether a read at ``read_ts`` sees all that can be; unknown timestamps admit nothing."""
    return ranges.withColumn("admitted", F.coalesce(F.col("closed") >= read_ts, F.lit(False)))


def fenced(log: DataFrame, group: str, lsn: str, epoch: str) -> DataFrame:
    """``log`` with ``accepted``: a writer of an older epoch than one seen before it, in order of positions, is fenced off."""
    so_far = F.max(epoch).over(Window.partitionBy(group).orderBy(lsn).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return log.withColumn("accepted", F.coalesce(F.col(epoch) >= so_far, F.lit(False)))


def apply_commands(table: DataFrame, log: DataFrame, key: str, applied: int, committed: int) -> DataFrame:
    """``table`` after the entries (index, kind, columns of the table) behind ``applied`` up to ``committed``, in order.

    A put replaces the row of its key, a delete removes it; other kinds change nothing. So the last
    put or delete of a key decides, and an entry that was applied before changes nothing.
    """
    due = log.where((F.col("index") > applied) & (F.col("index") <= committed) & F.col("kind").isin("put", "delete"))
    entry = F.struct("index", "kind", F.struct(*[F.col(c) for c in table.columns]).alias("row"))
    last = due.groupBy(F.col(key).alias("_key")).agg(F.max_by(entry, "index").alias("e"))
    kept = table.join(last, table[key] == last["_key"], "left_anti")
    return kept.unionByName(last.where("e.kind = 'put'").select("e.row.*"))


def paired(made: DataFrame) -> DataFrame:
    """(commit, snapshot, label): of each commit index the snapshot paired with it last, by sequence, and its label."""
    last = made.groupBy("commit").agg(F.max_by("snapshot", "seq").alias("snapshot"))
    return last.withColumn("label", F.concat(F.lit("commit-"), F.col("commit").cast("string")))


def proposed(log: DataFrame, requests: DataFrame, group: str, order: str) -> DataFrame:
    """``requests`` with their ``index`` in the log of their group: each group counts on from its own last index, in the order given."""
    ends = log.groupBy(group).agg(F.max("index").alias("_end"))
    nth = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return requests.withColumn("_n", nth).join(ends, group, "left").withColumn("index", F.col("_n") + F.coalesce("_end", F.lit(0))).drop("_n", "_end")
