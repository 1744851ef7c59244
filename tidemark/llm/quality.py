"""Quality by logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Features are a text's words and pairs of neighbouring words, hashed, with values log(1 + count)
scaled to length 1; a word that follows itself is one pair, whichever word it is. The trainer keeps for each feature the sum z of adjusted gradients and the sum
n of their squares; the weight that leads, |z| above the L1 penalty, follows from both when needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import small_batches, table
from tidemark.llm.labelled import labelled_sample, scored
from tidemark.llm.textnum import BASE, chunks, mixed, word_hashes

BITS = 18
#: Bound of the labelled rows that the model is fitted on, and the fold that is held out.
SAMPLE, MOD, HELD_OUT = 4000, 3, 1
REPEAT = 0x5851F42D4C957F2D  # the hash of that pair
#: Chosen on a validation part of the training folds, see ``selection``.
ALPHA, BETA, L1, L2, PASSES = 1.0, 1.0, 0.02, 0.05, 4


def features(texts: list[str | None]):
    """For each text (positions, values); (none, none) for a text without words. Whole texts, many at once."""
    for _, raw, starts in chunks(texts):
        h, ahead = word_hashes(raw, starts)
        one = (h >> np.uint64(64 - BITS)).astype(np.int64)
        same = h[1:] == h[:-1]
        two = (np.where(same, np.uint64(REPEAT), mixed(h[:-1] * BASE + h[1:])) >> np.uint64(64 - BITS)).astype(np.int64)
        for a, b in zip(ahead[:-1].tolist(), ahead[1:].tolist(), strict=True):
            at, n = np.unique(np.concatenate([one[a:b], two[a : max(a, b - 1)]]), return_counts=True)
            value = np.log1p(n)
            yield at, value / np.sqrt((value**2).sum()) if len(at) else value


def leaders(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def fit(sample: list[tuple[str, int]], bits: int = BITS) -> np.ndarray:
    """Weights of the hashed features, the bias behind them."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    rows = [(np.append(at, 1 << bits), np.append(v, 1.0), y) for (at, v), (_, y) in zip(features([t for t, _ in sample]), sample, strict=True)]
    order = np.random.default_rng(7)
    for _ in range(PASSES):
        for i in order.permutation(len(rows)):
            at, v, y = rows[i]
            w = leaders(z[at], n[at])
            g = (1 / (1 + np.exp(-np.clip(w @ v, -30, 30))) - y) * v
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    return leaders(z, n)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", rows: int = SAMPLE) -> DataFrame:
    """(id, held_out, score, predicted) of every row; null counts as empty, and a text without words has the score of the bias.

    Fitted on at most ``rows`` labelled documents; the weights, 2 MB whatever the data, go to the
    executors. Without labelled rows every score is 0.5, and 0.5 is predicted 1. Very long texts
    are scored whole, some at a time. Repeated rows have equal scores. Other columns, whatever
    their names, are not looked at. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(labelled_sample(docs, labels, label, rows, MOD, HELD_OUT, id_col, text_col)))

    def score(texts: list[str | None]) -> list[float]:
        w = shared.value
        s = np.array([w[at] @ v for at, v in features(texts)]) + w[-1]
        return (1 / (1 + np.exp(-s))).tolist()

    return scored(docs, score, MOD, HELD_OUT, id_col, text_col)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, held_out (crc32 fold 1 of 3), score, predicted."""
    out = quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return out.withColumnRenamed("id", "doc_id")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", rows: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that are predicted good, all columns as they were; no row moves.

    Null and empty texts have the score of the bias, repeated rows stay or go together, and an
    empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(labelled_sample(docs, labels, label, rows, MOD, HELD_OUT, id_col, text_col)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                s = np.array([w[at] @ v for at, v in features(part.column(text_col).to_pylist())]) + w[-1]
                yield part.filter(pa.array(s >= 0))

    return docs.mapInArrow(each, docs.schema)
