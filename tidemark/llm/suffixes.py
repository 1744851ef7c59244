"""Repeated passages by windows of words around content-selected positions.

A position is retained when its k-gram of words is the minimiser of some window; two texts that
share WINDOW + GRAM - 1 words retain the same position in them. Only positions whose k-gram
recurs in another document are followed: each ``least`` words in a row that hold such a k-gram
become one 64-bit hash, and those whose hash another document has too are shared. A passage of
``least`` or more words is shared just when each ``least`` words in a row of it are, so what
overlaps adds up to the passages, whichever of many documents it is shared with. Nothing is
compared with neighbours only, and no order of rows decides.

Documents with equal texts are one document until the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import hot_join, small_batches, staged, table
from tidemark.llm.textnum import BASE, chunks, mixed, word_hashes

GRAM, WINDOW = 8, 32
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def minimisers(h: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions retained, their k-gram hashes) among the word hashes of texts that start at ``ahead``.

    The leftmost of equal minima is taken. Where a word runs on, only each WINDOW-th k-gram of the
    run competes, counted from its start, so a long run retains few positions.
    """
    n = len(h) - GRAM + 1
    if n < WINDOW:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    g = np.zeros(n, dtype=np.uint64)
    for j in range(GRAM):
        g = g * BASE + h[j : j + n]
    g = mixed(g)
    first = np.concatenate([[True], g[1:] != g[:-1]])
    since = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
    bits = np.uint64(max(20, int(n).bit_length()))
    low = np.minimum(g >> bits, (TOP >> bits) - np.uint64(1)) << bits | np.arange(n, dtype=np.uint64)
    low[since % WINDOW != 0] = TOP
    size = 1
    while size < WINDOW:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    # windows inside one text: ahead[i] .. ahead[i + 1] - GRAM - WINDOW + 1
    a, b = ahead[:-1], np.maximum(ahead[:-1], ahead[1:] - GRAM - WINDOW + 2)
    marks = np.zeros(len(h) + 1, dtype=np.int64)
    np.add.at(marks, a, 1)
    np.add.at(marks, b, -1)
    inside = np.cumsum(marks)[: len(low)] > 0
    at = np.unique((low[inside] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64))
    return at, g[at]


def retained(docs: DataFrame) -> DataFrame:
    """(id, n_words, at, gram): retained positions of each text of (id, text), counted in its words."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, raw, starts in chunks(texts):
                h, ahead = word_hashes(raw, starts)
                at, gram = minimisers(h, ahead)
                cut = np.searchsorted(at, ahead).astype(np.int32)
                own = at - np.repeat(ahead[:-1], np.diff(cut))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(i, len(ahead) - 1), pa.array(np.diff(ahead).astype(np.int64)), pa.ListArray.from_arrays(cut, pa.array(own.astype(np.int32))), pa.ListArray.from_arrays(cut, pa.array(gram.view(np.int64)))],
                    names=["id", "n_words", "at", "gram"],
                )

    return docs.mapInArrow(each, "id long, n_words long, at array<int>, gram array<long>")


def window_hashes(h: np.ndarray, least: int) -> np.ndarray:
    """A hash of each ``least`` words in a row, from those of the words."""
    n = len(h) - least + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    found, done, part, size = np.zeros(len(h), dtype=np.uint64), 0, h, 1
    while True:  # hashes of 1, 2, 4 .. words, put together to the length wanted
        if least & size:
            shift = np.uint64(pow(int(BASE), size, 1 << 64))
            rest = part[done:]
            found, done = found[: len(rest)] * shift + rest, done + size
        if 2 * size > least:
            return mixed(found[:n])
        part = part[:-size] * np.uint64(pow(int(BASE), size, 1 << 64)) + part[size:]
        size *= 2


def windows(docs: DataFrame, least: int) -> DataFrame:
    """(id, hash, a): each ``least`` words of (id, text, at) from word a on that hold the k-gram of a position of ``at``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("at").to_pylist()
            for i, raw, starts in chunks(batch.column("text").to_pylist()):
                h, begin = word_hashes(raw, starts)
                hashes = window_hashes(h, least)
                for nth in range(len(begin) - 1):
                    n = int(begin[nth + 1] - begin[nth]) - least + 1
                    if n < 1:
                        continue
                    p = np.array(wanted[i + nth], dtype=np.int64)
                    marks = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(marks, np.clip(p - (least - GRAM), 0, n), 1)
                    np.add.at(marks, np.clip(p + 1, 0, n), -1)
                    a = np.flatnonzero(np.cumsum(marks[:n]) > 0)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), batch.column("id")[i + nth].as_py(), dtype=np.int64)), pa.array(hashes[a + begin[nth]].view(np.int64)), pa.array(a)], names=["id", "hash", "a"])

    return docs.mapInArrow(each, "id long, hash long, a long")


def repeated_passages(docs: DataFrame, least: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start_word, end_word, n_words, whole): maximal passages of ``least`` or more words that another document has too.

    Words are what stands between ASCII blanks, compared by 64-bit hashes of ``least`` words in a row. Of a group of equal texts of that
    length every row is one passage from end to end (``whole``). Every place of a passage is
    returned, the first one too; what repeats only within one document is not. Null and short
    texts, and null ids, have none. Documents are told apart by id: rows that repeat an id with
    other texts are taken for parts of one. ``least`` is at least WINDOW + GRAM - 1.
    """
    if least < WINDOW + GRAM - 1:
        raise ValueError(f"fewer than {WINDOW + GRAM - 1} words need not hold a retained position")
    small_batches(docs.sparkSession)
    text = F.coalesce(docs[text_col], F.lit(""))
    mine = docs.where(docs[id_col].isNotNull()).select(docs[id_col].cast("long").alias("id"), text.alias("text"))
    digests = staged(mine.select("id", F.unhex(F.sha2("text", 256)).alias("digest")).distinct(), "digests")
    groups = digests.groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    reps = staged(groups.select("rep", "digest", "n"), "representatives")
    kept = staged(retained(mine), "retained")
    own = kept.join(reps.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
    places = own.select("id", F.explode(F.arrays_zip("at", "gram")).alias("p")).select("id", F.col("p.at").alias("at"), F.col("p.gram").alias("gram"))
    again = staged(places.groupBy("gram").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("gram", "n"), "grams")
    chosen = hot_join(places, again, "gram", "left_semi").groupBy("id").agg(F.sort_array(F.collect_set("at")).alias("at"))
    one = mine.join(chosen, "id")
    rows = staged(windows(one.select("id", "text", "at"), least), "windows")
    twice = staged(rows.groupBy("hash").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("hash", "n"), "recurring")
    spans = staged(hot_join(rows, twice, "hash", "left_semi").select("id", "a", (F.col("a") + least).alias("b")), "shared")
    line = Window.partitionBy("id").orderBy("a", "b")
    reach = F.max("b").over(line.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", (reach.isNull() | (F.col("a") > reach)).cast("int")).withColumn("nth", F.sum("new").over(line))
    spans = spans.groupBy("id", "nth").agg(F.min("a").alias("start_word"), F.max("b").alias("end_word"))
    sizes = kept.groupBy("id").agg(F.max("n_words").alias("n_words"))
    copies = digests.join(reps.where("n > 1"), "digest").select("id").distinct().join(sizes, "id").where(F.col("n_words") >= least)
    whole = copies.select("id", F.lit(0).cast("long").alias("start_word"), F.col("n_words").alias("end_word"), "n_words", F.lit(True).alias("whole"))
    parts = spans.join(sizes, "id").join(copies.select("id"), "id", "left_anti")
    return whole.unionByName(parts.select("id", "start_word", "end_word", "n_words", F.lit(False).alias("whole")))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start_word, end_word, n_words, whole: every passage of 50 or more words that documents share."""
    return repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")
