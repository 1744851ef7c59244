"""Exact top-k search by Fagin's threshold algorithm over sorted per-dimension lists.

Candidates and queries are cut into blocks, and each pair of blocks is a task. A task sorts its
candidates by every dimension. For a query it reads the lists side by side, from the end that the
sign of the query's component favours, scores each candidate on first sight exactly, and stops
when the score that the last read components would add up to, which bounds every unseen
candidate, is below the k-th best. A candidate at the bound may win a tie, so equality goes on.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import staged, table

#: Rows of a block, and entries of each list that are read before the first look at the bound; twice as many before each further one.
CANDIDATES, QUERIES, DEPTH = 4096, 512, 4


def threshold_top(q: np.ndarray, own: np.ndarray, ids: np.ndarray, cand: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids, scores) of the k best rows of ``cand`` but the marked ``own``, and how many were scored; ``order`` sorts each dimension upwards."""
    n, dims = cand.shape
    seen, scored = own.copy(), 0
    up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
    best_ids, best = ids[:0], cand[:0, 0]
    if not len(up) and not len(down):
        seen, best_ids = np.ones(n, dtype=bool), ids[~seen]
        best = np.zeros(len(best_ids), dtype=cand.dtype)
        keep = np.argsort(best_ids, kind="stable")[:k]
        return best_ids[keep], best[keep], 0
    a, depth = 0, DEPTH
    while a < n:
        b, depth = min(n, a + depth), 2 * depth
        fresh = np.zeros(n, dtype=bool)
        fresh[order[n - b : n - a, up]] = True
        fresh[order[a:b, down]] = True
        new = np.flatnonzero(fresh & ~seen)
        if len(new):
            seen[new] = True
            scored += len(new)
            best_ids, best = np.concatenate([best_ids, ids[new]]), np.concatenate([best, cand[new] @ q])
            if best.dtype == object:
                keep = np.array(sorted(range(len(best)), key=lambda i: (-best[i], best_ids[i]))[:k], dtype=np.int64)
            else:
                keep = np.lexsort((best_ids, -best))[:k]
            best_ids, best = best_ids[keep], best[keep]
        bound = (cand[order[n - b, up], up] * q[up]).sum() + (cand[order[b - 1, down], down] * q[down]).sum()
        if len(best) == k and best[-1] > bound or seen.all():
            break
        a = b
    return best_ids, best, scored


def padded(vectors: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def integers(a: np.ndarray) -> np.ndarray:
    """Python's integers, of any size, for the whole numbers of ``a``."""
    return np.array([int(x) for x in a.ravel().tolist()], dtype=object).reshape(a.shape)


def as_long(scores: np.ndarray) -> np.ndarray:
    if scores.dtype == object and any(abs(x) >= 2**63 for x in scores):
        raise ValueError("a score among the best does not fit 64 bits")
    return scores.astype(np.int64)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for rows whose id is divisible by ``every`` the k best of all others.

    Components become floor(scale * x); the score is the inner product of integers, ties to the
    smaller id. Null vectors and ids and vectors with a null or non-finite component take no part.
    Scores are exact at any size; one among the best beyond 64 bits is an error. Every row is a
    candidate, also one that repeats an id or a whole row; a query meets all but its own row, and
    rows that repeat a query are queries of their own. Shorter vectors count as filled with zeros. Fewer rows than k: all.
    """
    v = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vec_col].alias("x"))
    fit = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    v = v.where(F.col("id").isNotNull() & F.col("x").isNotNull() & F.forall("x", fit))
    # doubles hold these whole numbers exactly; from 2**53 on a double is whole as it is
    whole = lambda y: F.when(F.abs(y) < 2**53, F.floor(y).cast("double")).when(F.abs(y) < float("inf"), y).otherwise(F.raise_error(F.lit("a scaled component is beyond doubles")).cast("double"))
    v = staged(v.select("id", F.transform("x", lambda x: whole(x.cast("double") * scale)).alias("v")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    rows, asked = v.agg(F.count(F.lit(1)), F.count(F.when(F.pmod("id", F.lit(every)) == 0, 1))).first()
    n, m = max(1, -(-rows // CANDIDATES)), max(1, -(-asked // QUERIES))
    blocks = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    queries = v.where(F.pmod("id", F.lit(every)) == 0).withColumn("q", F.pmod(F.xxhash64("row"), F.lit(m)).cast("int")).withColumn("c", blocks(n))
    candidates = v.withColumn("c", F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")).withColumn("q", blocks(m))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            dims = max(left["v"].map(len).max(), right["v"].map(len).max())
            q, cand, ids = padded(left["v"], dims), padded(right["v"], dims), right["id"].to_numpy()
            order = np.argsort(cand, axis=0, kind="stable") if dims else None
            bound = int(np.abs(q).max(initial=0)) * int(np.abs(cand).max(initial=0)) * max(int(dims), 1)
            if bound >= 2**53:  # below, doubles are exact, and faster
                q, cand = (integers(q), integers(cand)) if bound >= 2**63 else (q.astype(np.int64), cand.astype(np.int64))
            rows = right["row"].to_numpy()
            for query, row, one in zip(left["id"].to_numpy(), left["row"].to_numpy(), q, strict=True):
                if dims:
                    best_ids, best, _ = threshold_top(one, rows == row, ids, cand, order, k)
                else:
                    best_ids = np.sort(ids[rows != row])[:k]
                    best = np.zeros(len(best_ids))
                found.append(pd.DataFrame({"query_id": query, "own": row, "vec_id": best_ids, "score": as_long(best)}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "own": [], "vec_id": [], "score": []}, dtype="int64")

    best = queries.groupBy("q", "c").cogroup(candidates.groupBy("q", "c")).applyInPandas(meet, "query_id long, own long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "own").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score of the 5 best for every 50th vector."""
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 50 = 0)
SELECT query_id, CAST(rk AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk FROM s) WHERE rk <= 5
"""
