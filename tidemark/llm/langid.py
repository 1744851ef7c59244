"""Language ID by a bidirectional gated recurrent network over bytes, in numpy.

A text's UTF-8 bytes are read in windows of ``WINDOW``, every window of the whole text. In each
window one recurrence runs forwards and one backwards; both states together label every byte with
a probability for each language, and a document's probabilities are the means over its bytes.
Training is by backpropagation through time on windows of a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bucket_of, small_batches, table

WINDOW, HIDDEN, BATCH = 64, 8, 2048
#: Bound of the documents that the model is fitted on (each language's first ones come first),
#: of windows from each, the training steps and windows in a step.
SAMPLE, FROM_EACH, STEPS, STEP_WINDOWS, RATE = 1200, 6, 110, 192, 0.02
PART_BITS = 12  # ranges of hashes that are counted for each language: 2**PART_BITS
MOD, HELD_OUT = 4, 2
UNKNOWN = "und"


class Network:
    """Parameters of both directions on the first axis; gates z and r, then the candidate, on the last."""

    def __init__(self, languages: list[str], seed: int = 11):
        r, h = np.random.default_rng(seed), HIDDEN
        self.languages = languages
        self.p = {
            "inp": r.normal(0, 0.3, (2, 256, 3 * h)), "rec": r.normal(0, 1 / np.sqrt(h), (2, h, 3 * h)), "bias": np.zeros((2, 1, h)), "out": r.normal(0, 0.3, (2 * h, len(languages))), "off": np.zeros(len(languages))
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def states(self, x: np.ndarray, tape: list | None = None) -> np.ndarray:
        """(window position, window, 2 * HIDDEN) of bytes (position, window); ``tape`` gets what backpropagation needs."""
        p, h, (t, n) = self.p, HIDDEN, x.shape
        out = np.empty((t, n, 2 * h), dtype=np.float32)
        state = np.zeros((2, n, h), dtype=np.float32)
        given = np.empty((2, n, 3 * h), dtype=np.float32)
        for k in range(t):
            np.take(p["inp"][0], x[k], axis=0, out=given[0])
            np.take(p["inp"][1], x[t - 1 - k], axis=0, out=given[1])
            rec = state @ p["rec"]
            gate = given[..., : 2 * h] + rec[..., : 2 * h]
            np.tanh(gate, out=gate)  # the logistic function of twice the argument, scaled below
            gate += 1
            gate *= 0.5
            z, r = gate[..., :h], gate[..., h:]
            inner = rec[..., 2 * h :] + p["bias"]
            cand = np.tanh(given[..., 2 * h :] + r * inner)
            if tape is not None:
                tape.append((state, z, r, inner, cand))
            state = state + z * (cand - state)
            out[k, :, :h], out[t - 1 - k, :, h:] = state[0], state[1]
        return out

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        e = states @ self.p["out"] + self.p["off"]
        e -= e.max(axis=-1, keepdims=True)
        np.exp(e, out=e)
        e /= e.sum(axis=-1, keepdims=True)
        return e

    def slopes(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross-entropy over the bytes that ``mask`` marks, by backpropagation through time."""
        p, h, (t, n) = self.p, HIDDEN, x.shape
        tape: list = []
        states = self.states(x, tape)
        d = self.probabilities(states)
        d[:, np.arange(n), y] -= 1
        d *= (mask / mask.sum())[..., None]
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["out"] = np.tensordot(states, d, ([0, 1], [0, 1]))
        g["off"] = d.sum(axis=(0, 1))
        back = d @ p["out"].T
        carry = np.zeros((2, n, h), dtype=np.float32)
        for k in reversed(range(t)):
            before, z, r, inner, cand = tape[k]
            carry = carry + np.stack([back[k, :, :h], back[t - 1 - k, :, h:]])
            dc = carry * z * (1 - cand**2)
            dz = carry * (cand - before) * 2 * z * (1 - z)
            dr = dc * inner * 2 * r * (1 - r)
            given = np.concatenate([dz, dr, dc], axis=-1)
            rec = np.concatenate([dz, dr, dc * r], axis=-1)
            for way, at in ((0, k), (1, t - 1 - k)):
                np.add.at(g["inp"][way], x[at], given[way])
            g["rec"] += before.transpose(0, 2, 1) @ rec
            g["bias"] += (dc * r).sum(axis=1, keepdims=True)
            carry = carry * (1 - z) + rec @ p["rec"].transpose(0, 2, 1)
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> None:
        """Adam steps on windows drawn evenly from the languages."""
        r = np.random.default_rng(5)
        of = [np.flatnonzero(y == c) for c in range(len(self.languages))]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, STEPS + 1):
            at = np.concatenate([r.choice(f, max(1, STEP_WINDOWS // len(of))) for f in of if len(f)])
            rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
            for k, g in self.slopes(x[:, at], y[at], mask[:, at]).items():
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
                self.p[k] -= (rate * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """(language, its pooled probability) of whole texts; without a letter, or nothing learned: und and 0."""
        raw = [t.encode("utf-8", "surrogatepass") if t and self.languages and any(map(str.isalpha, t)) else b"" for t in texts]
        sums = np.zeros((len(texts), len(self.languages)))
        held: list[tuple[int, bytes]] = []
        for i, text in enumerate(raw):
            for k in range(0, len(text), WINDOW * BATCH):
                held.append((i, text[k : k + WINDOW * BATCH]))
        at = 0
        while at < len(held):
            j, n = at, 0
            while j < len(held) and (j == at or n + -(-len(held[j][1]) // WINDOW) <= BATCH):
                n += -(-len(held[j][1]) // WINDOW)
                j += 1
            x, mask, of = windows([b for _, b in held[at:j]])
            pooled = np.einsum("tnl,tn->nl", self.probabilities(self.states(x)), mask)
            np.add.at(sums, np.array([i for i, _ in held[at:j]])[of], pooled)
            at = j
        names, scores = [], []
        for s, text in zip(sums, raw, strict=True):
            best = int(s.argmax()) if text else -1
            names.append(self.languages[best] if text else UNKNOWN)
            scores.append(min(1.0, float(s[best]) / len(text)) if text else 0.0)
        return names, scores


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes by position and window, 1 where a byte is and 0 behind a text's end, text of each window)."""
    n = np.array([-(-len(t) // WINDOW) for t in texts], dtype=np.int64)
    of = np.repeat(np.arange(len(texts)), n)
    raw = np.frombuffer(b"".join(t.ljust(int(k) * WINDOW, b"\0") for t, k in zip(texts, n, strict=True)), dtype=np.uint8).reshape(-1, WINDOW)
    ends = np.array([len(t) for t in texts])[of] - WINDOW * (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n))
    return np.ascontiguousarray(raw.T).astype(np.intp), (np.arange(WINDOW)[:, None] < ends).astype(np.float32), of


def trained(sample: list[tuple[str, str]]) -> Network:
    """A network fitted on (text, language) rows: windows spread over each whole text."""
    languages = sorted({lang for _, lang in sample})
    net, r = Network(languages), np.random.default_rng(3)
    texts, y = [], []
    for text, lang in sample:
        raw = text.encode("utf-8", "surrogatepass")
        for a in r.integers(0, max(1, len(raw) - WINDOW + 1), FROM_EACH if len(raw) > WINDOW else 1):
            if raw:
                texts.append(raw[a : a + WINDOW])
                y.append(languages.index(lang))
    if len(languages) > 1 and texts:
        x, mask, _ = windows(texts)
        net.fit(x, np.array(y), mask)
    return net


def language_sample(docs: DataFrame, rows: int, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, str]]:
    """At most ``rows`` (text, language) of documents outside the held-out fold.

    Ids are chosen first, by a hash within each language, so that every language is there as long
    as there are fewer than ``rows``; only they are broadcast, and only their texts collected. An
    id that is repeated gives one text for each of its languages, that of the least hash.
    """
    known = docs.where(docs[id_col].isNotNull() & docs[lang_col].isNotNull() & (bucket_of(docs[id_col], MOD) != HELD_OUT)).select(docs[id_col].alias("id"), docs[lang_col].alias("lang"), F.xxhash64(docs[id_col]).alias("h"))
    # a language may hold most rows: counts by range of hashes say in which ranges its first ones lie
    known = known.withColumn("part", F.shiftright("h", 64 - PART_BITS))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = known.groupBy("lang", "part").agg(F.count("*").alias("n")).withColumn("before", before).where(F.col("before") < rows)
    first = known.join(ranges, ["lang", "part"], "left_semi")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))
    chosen = first.withColumn("nth", nth).where(F.col("nth") <= rows).orderBy("nth", "h", "id", "lang").limit(rows).select("id", "lang").distinct()
    mine = docs.select(docs[id_col].alias("id"), docs[lang_col].alias("lang"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    found = mine.join(F.broadcast(chosen), ["id", "lang"]).groupBy("id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return [(r["text"], r["lang"]) for r in sorted(found.collect(), key=lambda r: (r["id"], r["lang"]))]


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE) -> DataFrame:
    """(id, held_out, lang_pred, score) of every row, from its whole text alone.

    Null, empty and letterless texts are ``und`` with score 0, as is every text when no row has a
    language. The network, some 60 KB whatever the data, goes to the executors. Very long texts
    are read whole, window by window. Repeated rows have equal results; of languages with equal
    probabilities the first by code point is taken. Other columns, whatever their names, are not
    looked at. An empty table gives an empty result. It is fitted on ``rows`` documents at most,
    and on ``FROM_EACH`` windows of each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trained(language_sample(docs, rows, id_col, text_col, lang_col)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                names, scores = shared.value.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(each, f"id {kind}, lang_pred string, score double")
    return out.select("id", (bucket_of(F.col("id"), MOD) == HELD_OUT).alias("held_out"), "lang_pred", "score")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, held_out (crc32 fold 2 of 4), lang_pred, score."""
    return language_id(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).withColumnRenamed("id", "doc_id")
