"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Vectors are cut into blocks, queries too; every pair of blocks is a cell of its own. In a cell
each dimension is a list of the candidates sorted by component, read from its top for a positive
query component and from its bottom for a negative one. After a stretch of all lists a candidate's
score lies between what was read plus the least and plus the most that the unread lists can add.
Candidates whose upper bound is below the k-th best lower bound are outsiders; once few others are
left, their scores are resolved and reading stops. Some hundred queries of a cell read in step, so
the bounds of a stretch are three matrix products.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..session import Scratch

QUERIES, CANDIDATES = 16_384, 8192  # rows of a cell: a candidate travels once per so many queries
AT_ONCE = 512  # queries that read in step
STRETCHES = (0.125, 0.25, 0.5, 0.75, 1.0)  # shares of the lists read, one after the other


def nra(queries: np.ndarray, vectors: np.ndarray, same: np.ndarray, k: int, few: int = 8):
    """For each query the indexes of candidates that can be among its k best, with their scores.

    ``same[q, c]`` marks pairs that don't count. Integers; exact in floating point below 2**53,
    and in single precision where no sum can pass 2**24.
    """
    m, d = vectors.shape
    bound = (np.abs(queries).max(axis=0, initial=0) * np.abs(vectors).max(axis=0, initial=0)).sum() if m else 0
    kind = np.float32 if bound < 2**24 else np.float64
    x = vectors.astype(kind)
    up, down = np.maximum(queries, 0).astype(kind).T, np.minimum(queries, 0).astype(kind).T  # d x q
    order = np.argsort(x, axis=0, kind="stable")  # ascending lists
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(m)[:, None], axis=0)
    ranked = np.take_along_axis(x, order, axis=0)
    out: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(queries)
    open_ = np.arange(len(queries))
    for share in STRETCHES:
        depth = max(min(m, k), int(np.ceil(m * share)))
        high, low = place >= m - depth, place < depth  # read from the top, from the bottom
        u, v = up[:, open_], down[:, open_]
        read = np.hstack([x * high, x * low]) @ np.vstack([u, v])
        if depth < m:
            unread = np.hstack([~high, ~low]).astype(kind)
            most = unread @ np.vstack([u * ranked[m - depth - 1][:, None], v * ranked[depth][:, None]])
            least = unread @ np.vstack([u * ranked[0][:, None], v * ranked[-1][:, None]])
        else:
            most = least = np.zeros_like(read)
        floor = np.where(same[open_].T, -np.inf, read + least)
        ceiling = np.where(same[open_].T, -np.inf, read + most)
        kth = np.partition(floor, m - k, axis=0)[m - k] if m > k else np.full(len(open_), -np.inf)
        alive = (ceiling >= kth) & (ceiling > -np.inf)
        ready = (alive.sum(axis=0) <= few * k) | (depth == m)
        for column in np.flatnonzero(ready):
            q, left = open_[column], np.flatnonzero(alive[:, column])
            out[q] = left, vectors[left] @ queries[q]
        open_ = open_[~ready]
        if not len(open_):
            break
    return out


def quantized(vectors: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """(vec_id, dims, v): floor(scale * x) per component; only whole, finite vectors with an id."""
    each = F.col(embedding).cast("array<double>")
    # Scores and their bounds stay below 2**53, where doubles are exact.
    most = F.sqrt(F.lit(2.0**53) / F.greatest(F.size(embedding), F.lit(1)))

    def number(x):
        told = F.concat(F.lit(f"a component times {scale} is not below "), F.floor(most).cast("string"))
        told = F.raise_error(told).cast("bigint")
        return F.when(F.abs(x * scale) < most, F.floor(x * scale).cast("bigint")).otherwise(told)

    whole = F.forall(each, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & whole).select(
        F.col(vec_id).cast("bigint").alias("vec_id"),
        F.size(embedding).alias("dims"),
        F.transform(each, number).alias("v"),
    )


def top_k(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 5, every: int = 50, scale: int = 256
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query, ties to the smaller id.

    Queries are the rows whose id is divisible by ``every``; candidates all rows of the same number of
    dimensions with another id. Null ids, null vectors and vectors with a null or non-finite component
    take no part. Equal rows that repeat an id are one row; rows that repeat it with other components
    are rows of their own. A component beyond what scores are exact for (after scaling, the root of
    2**53 / dimensions: 11,863,283 at 64) fails the job.
    """
    work = Scratch(vectors.sparkSession, "top-k")
    rows = work.cut(quantized(vectors, vec_id, embedding, scale).distinct(), "rows")
    queries = rows.filter(F.col("vec_id") % every == 0)
    counted = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    blocks, query_blocks = max(1, -(-counted[0] // CANDIDATES)), max(1, -(-counted[1] // QUERIES))
    spread = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")
    cell = F.concat_ws("-", "dims", "qb", "cb").alias("cell")
    asked = queries.withColumn("qb", spread(query_blocks)).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    held = rows.withColumn("cb", spread(blocks)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    asked = asked.select(cell, "vec_id", "v")
    held = held.select(cell.alias("at"), "vec_id", "v")

    def search(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "query", "vec_id", "score"]
        if not len(asked) or not len(held):
            return pd.DataFrame({n: [] for n in names}).astype({"query_id": "int64", "query": "int32", "vec_id": "int64", "score": "int64"})
        asked = asked.sort_values("vec_id", kind="stable").reset_index(drop=True)
        ids, mine = held["vec_id"].to_numpy(), asked["vec_id"].to_numpy()
        q, x = (np.stack([np.asarray(v, np.int64) for v in f["v"]]) for f in (asked, held))
        parts = []
        found = (f for at in range(0, len(q), AT_ONCE) for f in nra(q[at : at + AT_ONCE], x, mine[at : at + AT_ONCE, None] == ids[None, :], k))
        for i, (left, scores) in enumerate(found):
            best = np.lexsort((ids[left], -scores))[:k]
            parts.append(pd.DataFrame({"query_id": mine[i], "query": zlib.crc32(q[i].tobytes()) >> 1, "vec_id": ids[left][best], "score": scores[best]}))
        return pd.concat(parts)

    found = asked.groupBy("cell").cogroup(held.groupBy("at")).applyInPandas(search, "query_id bigint, query int, vec_id bigint, score bigint")
    ranked = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
