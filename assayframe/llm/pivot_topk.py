"""Exact top-k by inner product, with a pivot table that bounds and eliminates candidates.

Vectors are extended by one component that gives all the same norm, so a larger inner product is a smaller distance.
A table of distances to ``N_PIVOTS`` pivots is computed once for every candidate and written beside it; by the triangle
inequality the largest difference between a query's and a candidate's pivot distances is a lower bound of their distance. A query
evaluates candidates in order of that bound and stops once the bound exceeds its k-th best distance, so the result is
exact. Scores are integer inner products; bounds are rounded down by more than their rounding error.

Work is a grid: candidates in blocks of about ``BLOCK`` rows by hash, queries in blocks of about ``QUERY_BLOCK``
rows, and each query block meets each candidate block in a task of its own, so nothing is broadcast but the pivots
(``N_PIVOTS`` vectors). Each block pair yields k rows a query, merged by a grouped top k.

Defined cases: vectors that are null or hold a null or non-finite component take no part, on either side; shorter
vectors are filled up with zeros; a query's own row is any row with its id; ties go to the smaller id; rows repeated
with one id count once, the largest score winning, and as a query the least of their vectors; fewer candidates than k give all; no query or an empty table gives
no row; other columns are ignored. Scores are exact up to 2**62: a vector whose scaled length may be 2**31 or more is an error that names it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayframe.llm._shared import written

N_PIVOTS, PIVOT_POOL = 24, 2048
BLOCK, QUERY_BLOCK = 16_384, 2_048
MOST = float(1 << 31)
_PAIR = "query_id bigint, vec_id bigint, score bigint"


def usable(vectors: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id and v, the components times scale rounded down; only rows that take part."""
    v = F.col(vector).cast("array<double>")
    plain = vectors.where(F.col("vec_id").isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    # no product of two vectors exceeds the product of their lengths
    far = F.coalesce(F.array_max(F.transform(v, F.abs)), F.lit(0.0)) * scale >= MOST / F.sqrt(F.greatest(F.size(v), F.lit(1)))
    error = F.raise_error(F.concat(F.lit("components of vector "), F.col("vec_id").cast("string"), F.lit(" are too large for exact scores")))
    return plain.select(F.col("vec_id").cast("bigint"), F.when(far, error).otherwise(F.transform(v, lambda x: F.floor(x * scale))).alias("v"))


def _matrix(column: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(column), dims), np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def choose_pivots(vectors: np.ndarray, n: int) -> np.ndarray:
    """Vectors far from each other: each next one is farthest from those chosen."""
    x = vectors.astype(np.float64)
    far = ((x - x.mean(axis=0)) ** 2).sum(axis=1)
    chosen: list[int] = []
    for _ in range(min(n, len(x))):
        chosen.append(int(far.argmax()))
        own = ((x - x[chosen[-1]]) ** 2).sum(axis=1)
        far = own if len(chosen) == 1 else np.minimum(far, own)
    return vectors[chosen]


def _distances(x: np.ndarray, norm2: np.ndarray, lift: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of extended vectors (squared norm norm2 + lift**2) to pivots, which are extended by 0."""
    p = pivots.astype(np.float64)
    d2 = (norm2 + lift**2)[:, None] + (p**2).sum(axis=1)[None, :] - 2.0 * (x.astype(np.float64) @ p.T)
    return np.sqrt(np.maximum(d2, 0.0))


def pivot_table(x: np.ndarray, pivots: np.ndarray, most: float) -> np.ndarray:
    """Distances of candidates, extended to the squared norm ``most``, to all pivots."""
    norm2 = (x.astype(np.float64) ** 2).sum(axis=1)
    return _distances(x, norm2, np.sqrt(np.maximum(most - norm2, 0.0)), pivots)


def eliminate(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, table: np.ndarray, pivots: np.ndarray, most: float, k: int, chunk: int = 512, seen: list | None = None):
    """The k best (query id, id, score) of each query among x, whose distances to pivots are ``table``; ``most``: the largest squared norm of any candidate.

    Candidates are taken in order of their bounds, ``chunk`` at first and then four times as many, found by partial sorts; ``seen`` gets how many each query was compared with.
    """
    q_norm2 = (q.astype(np.float64) ** 2).sum(axis=1)
    q_table = _distances(q, q_norm2, np.zeros(len(q)), pivots)
    slack = 1e-6 * (np.sqrt(most) + np.sqrt(q_norm2.max(initial=0.0)) + 1.0)
    # products of floats are exact while all sums stay under 2**53
    if most * q_norm2.max(initial=0.0) < 2.0**104:
        x, q = x.astype(np.float64), q.astype(np.float64)
    out = []
    for i in range(len(q)):
        bound = np.abs(table - q_table[i]).max(axis=1) if len(pivots) else np.zeros(len(x))
        left = np.flatnonzero(x_ids != q_ids[i])
        ids, scores, worst, met, most_rows = np.zeros(0, np.int64), np.zeros(0, np.int64), np.inf, 0, chunk
        while len(left):
            if len(left) > most_rows:
                part = np.argpartition(bound[left], most_rows)
                rows, left = left[part[:most_rows]], left[part[most_rows:]]
                most_rows *= 4
            else:
                rows, left = left, left[:0]
            rows = rows[bound[rows] <= worst]
            met += len(rows)
            ids, scores = np.concatenate([ids, x_ids[rows]]), np.concatenate([scores, (x[rows] @ q[i]).astype(np.int64)])
            best = np.lexsort((ids, -scores))
            _, first = np.unique(ids[best], return_index=True)
            best = best[np.sort(first)][:k]
            ids, scores = ids[best], scores[best]
            if len(ids) == k:
                worst = np.sqrt(max(most + q_norm2[i] - 2.0 * scores[-1], 0.0)) + slack
                left = left[bound[left] <= worst]  # every other bound exceeds the k-th best distance
        if seen is not None:
            seen.append(met)
        out.append((np.full(len(ids), q_ids[i]), ids, scores))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, n_pivots: int = N_PIVOTS) -> DataFrame:
    """vec_id and v (bigint arrays) of candidates and of queries to query_id, rank, vec_id, score."""
    candidates = written(vectors.select("vec_id", "v"), "vectors")
    asked = written(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    seen = candidates.agg(
        F.count("*").alias("n"),
        F.max(F.size("v")).alias("dims"),
        F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).alias("most"),
    ).first()
    n_queries, widest = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    dims, most = max(seen["dims"] or 0, widest or 0), float(seen["most"] or 0.0)
    # a bounded pool with the smallest hashes of ids; any pivots give right results
    pool = candidates.orderBy(F.xxhash64("vec_id")).limit(PIVOT_POOL).toPandas()
    pivots = choose_pivots(_matrix(pool["v"], dims), n_pivots)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(pivots=list(pivot_table(_matrix(batch["v"], dims), pivots, most)))

    candidates = written(candidates.mapInPandas(measure, "vec_id bigint, v array<bigint>, pivots array<double>"), "pivots")
    blocks, q_blocks = -(-seen["n"] // BLOCK) or 1, -(-n_queries // QUERY_BLOCK) or 1
    spread = F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)).cast("int")
    q_spread = F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(q_blocks)).cast("int")
    grid = [F.col("q").cast("int"), F.col("b").cast("int")]
    left = candidates.select("vec_id", "v", "pivots", spread.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("q"))
    right = asked.select("vec_id", "v", q_spread.alias("q"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))

    def meet(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(q):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        a, b, s = eliminate(_matrix(q["v"], dims), q["vec_id"].to_numpy(), _matrix(x["v"], dims), x["vec_id"].to_numpy(), np.stack(x["pivots"].to_numpy()), pivots, most, k)
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": s})

    pairs = left.groupBy(*grid).cogroup(right.groupBy(*grid)).applyInPandas(meet, _PAIR)
    best = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
