"""A bounded sample of labelled documents for the driver, and scoring by a fitted model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bucket_of, small_batches


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, mod: int, held_out: int, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int]]:
    """At most ``rows`` (text, label), whole texts, of documents whose fold is not ``held_out``.

    The sample is chosen among the labels, by a hash of their ids, so no text is sorted or moved;
    the chosen labels, at most ``rows`` of them, are what is broadcast. Labels other than 0 and 1
    are left out; an id labelled twice has its larger label, and an id with several texts gives one
    of them, that of the least hash. Null texts count as empty, very long ones are taken whole.
    """
    fit = labels.where(labels[id_col].isNotNull() & labels[label].isin(0, 1)).where(bucket_of(labels[id_col], mod) != held_out)
    chosen = fit.groupBy(labels[id_col].alias("id")).agg(F.max(label).alias("y")).orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("t"))
    found = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min_by("t", F.xxhash64("t")).alias("t"), F.max("y").alias("y"))
    return [(r["t"], int(r["y"])) for r in sorted(found.collect(), key=lambda r: r["id"])]


def scored(docs: DataFrame, score: Callable[[list[str | None]], list[float]], mod: int, held_out: int, id_col: str = "doc_id", text_col: str = "text", keep: list[Column] = ()) -> DataFrame:
    """(id, score, held_out, predicted) of each row, by ``score`` on its whole text alone."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(score(part.column("text").to_pylist()), pa.float64())], names=["id", "score"])

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(each, f"id {kind}, score double")
    return out.select("id", (bucket_of(F.col("id"), mod) == held_out).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
