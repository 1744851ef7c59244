"""Toxicity by a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct n-grams of its UTF-8 bytes, A-Z lower-cased, hashed. Each is
worth the log of how much more often toxic training texts have it than others do; a logistic
regression on these values is fitted by full-batch gradient steps with a quadratic penalty.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table
from tidemark.llm.labelled import labelled_sample, scored
from tidemark.llm.textnum import BASE

BITS, SIZES = 18, (3, 4, 5)
#: Bound of the labelled rows that the model is fitted on, and the fold that is held out.
SAMPLE, MOD, HELD_OUT = 4000, 5, 0
#: Chosen on a validation part of the training folds, see ``selection``.
STEPS, RATE, PENALTY, PRIOR = 64, 0.012, 1e-3, 1.0


def grams(text: str | None) -> np.ndarray:
    """Distinct hashed n-grams of a whole text between blanks, sorted."""
    raw = np.frombuffer(b" " + (text or "").encode("utf-8", "surrogatepass").lower() + b" ", dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    h, found = np.zeros(len(raw), dtype=np.uint64), []
    for n in range(1, min(max(SIZES), len(raw)) + 1):
        h = h[: len(raw) - n + 1] * BASE + raw[n - 1 :]
        if n in SIZES:
            found.append((h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.int32))
    if not found:
        return np.zeros(0, dtype=np.int32)
    every = np.concatenate(found)
    every.sort()
    return every[np.concatenate([[True], every[1:] != every[:-1]])]


def fit(sample: list[tuple[str, int]]) -> tuple[np.ndarray, float]:
    """(weight of each hashed n-gram, bias). Without rows of both labels: nothing but the bias."""
    y = np.array([label for _, label in sample], dtype=np.float64)
    n, up = len(y), y.sum()
    if not 0 < up < n:
        return np.zeros(1 << BITS, dtype=np.float32), float(np.log((up + PRIOR) / (n - up + PRIOR)))
    x = [grams(t) for t, _ in sample]
    sizes = np.array([len(f) for f in x])
    at, row = np.concatenate(x), np.repeat(np.arange(n), sizes)
    seen = lambda v: PRIOR + np.bincount(at, weights=v[row], minlength=1 << BITS)
    ratio = np.log(seen(y) / (up + 2 * PRIOR)) - np.log(seen(1 - y) / (n - up + 2 * PRIOR))
    value = ratio[at].astype(np.float32)
    w, bias = np.zeros(1 << BITS), float(np.log(up / (n - up)))
    m, v, mb, vb = np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0
    for k in range(1, STEPS + 1):
        z = np.bincount(row, weights=w.astype(np.float32)[at] * value, minlength=n) + bias
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        slope = np.bincount(at, weights=g[row] * value, minlength=1 << BITS) + PENALTY * w
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        mb, vb = 0.9 * mb + 0.1 * g.sum(), 0.99 * vb + 0.01 * g.sum() ** 2
        step = lambda a, b: RATE * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-9)  # noqa: E731, B023
        w, bias = w - step(m, v), bias - step(mb, vb)
    return (w * ratio).astype(np.float32), float(bias)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", rows: int = SAMPLE) -> DataFrame:
    """(id, held_out, score, predicted) of every row; null counts as empty, and empty texts have the score of no n-gram but that of the blanks.

    Very long texts are scored whole. Repeated rows have equal scores; a score of 0.5 is predicted
    1. Without labelled rows of both labels every score is that of the bias. Other columns,
    whatever their names, are not looked at. An empty table gives an empty result.

    Fitted on at most ``rows`` labelled documents; the weights, 1 MB whatever the data, go to the executors.
    """
    weights, bias = fit(labelled_sample(docs, labels, label, rows, MOD, HELD_OUT, id_col, text_col))
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def score(texts: list[str | None]) -> list[float]:
        w = shared.value
        z = np.array([w[grams(t)].sum(dtype=np.float64) for t in texts]) + bias
        return (1 / (1 + np.exp(-np.clip(z, -700, 700)))).tolist()

    return scored(docs, score, MOD, HELD_OUT, id_col, text_col)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, held_out (crc32 fold 0 of 5), score, predicted."""
    out = toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return out.withColumnRenamed("id", "doc_id")
