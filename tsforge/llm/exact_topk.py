"""Exact top-k by inner product: branch and bound over blocks of dimensions.

Candidates lie in vertical layout (one row per dimension). For a batch of queries the scores are accumulated one block
of dimensions after the other; after each block a candidate's score lies within the product of both remaining norms of
what has been summed (Cauchy-Schwarz), so candidates whose upper bound falls below the k-th best lower bound are
dropped and the rest is compacted before the next block. Only candidates that cannot be among the k best are dropped.

The stated queries meet all candidates in blocks: candidates are dealt into groups, queries into groups, and each
(candidate group, query group) cell is one bounded piece of work that returns k rows per query. No cell depends on how
often a vector repeats, and the number of cells follows the row counts.

Components become integers, floor(scale * x) of x as double. Sums are exact: in doubles where they fit into 53 bits, else
in Python integers; scores beyond a long are cut to its range.

Defined cases: vectors that are NULL or hold NULL or non-finite components, and rows without vec_id, take no part; short
vectors count as padded with zeros, so an empty one scores 0; a row never meets rows of its own vec_id; rows repeated
with one vec_id are candidates each, and each of their different vectors is one query; ties go to the smaller vec_id; with
fewer than k candidates all are returned.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 5
SCALE = 256
DIMENSIONS = 16
CANDIDATES_PER_CELL = 8_192
QUERIES_PER_CELL = 2_048
QUERY_BATCH = 64
LONG = (-(2**63), 2**63 - 1)


def _matrix(column: pa.ChunkedArray, scale: int) -> tuple[np.ndarray, bool]:
    """Vectors as rows, padded with zeros; whether doubles hold them (else Python integers)."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(flat.offsets.to_numpy())
    values = np.floor(flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    width = int(sizes.max()) if len(sizes) else 0
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = values
    return out, not values.size or float(np.abs(values).max()) < 2.0**26


def _widened(m: np.ndarray, width: int) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, width - m.shape[1]))) if m.shape[1] < width else m


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def search_cell(
    candidates: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, block: int
) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For every query: its number, and ids and scores of its k best candidates, by branch and bound."""
    width = candidates.shape[1]
    columns = np.ascontiguousarray(candidates.T)
    starts = list(range(0, width, block)) or [0]
    # Norm of what is left from each block on.
    rest_c = [np.sqrt((columns[s:] ** 2).sum(axis=0)) for s in starts[1:]]
    rest_q = [np.sqrt((queries[:, s:] ** 2).sum(axis=1)) for s in starts[1:]]
    found = []
    for low in range(0, len(queries), QUERY_BATCH):
        batch = queries[low : low + QUERY_BATCH]
        first = batch[:, :block] @ columns[:block]
        for i, partial in enumerate(first):
            q, alive, scores = low + i, np.flatnonzero(ids != own[low + i]), None
            scores = partial[alive]
            for step in range(1, len(starts)):
                if len(alive) > k:
                    slack = rest_q[step - 1][q] * rest_c[step - 1][alive] * (1 + 1e-9) + 1e-6
                    floor = np.partition(scores - slack, len(alive) - k)[len(alive) - k]
                    live = scores + slack >= floor
                    alive, scores = alive[live], scores[live]
                s = starts[step]
                scores = scores + queries[q, s : s + block] @ columns[s : s + block, alive]
            top = _best(scores, ids[alive], k)
            found.append((q, ids[alive][top], scores[top]))
    return found


def _search_large(candidates, ids, queries, own, k):
    """The same for integers too large for doubles."""
    whole = [[int(x) for x in row] for row in candidates]
    for q, row in enumerate(queries):
        numbers = [int(x) for x in row]
        scored = sorted(
            (-min(max(sum(a * b for a, b in zip(numbers, c)), LONG[0]), LONG[1]), int(i))
            for c, i in zip(whole, ids)
            if i != own[q]
        )[:k]
        yield q, np.array([i for _, i in scored], dtype=np.int64), [-s for s, _ in scored]


def cell_function(k: int, scale: int, block: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "_q": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            (c, small_c), (q, small_q) = _matrix(left["embedding"], scale), _matrix(right["embedding"], scale)
            width = max(c.shape[1], q.shape[1])
            c, q = _widened(c, width), _widened(q, width)
            ids, own = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
            marks = right["_q"].to_numpy()
            fits = small_c and small_q and np.abs(c).max(initial=0) * np.abs(q).max(initial=0) * width < 2.0**53
            found = search_cell(c, ids, q, own, k, block) if fits else _search_large(c, ids, q, own, k)
            for i, best, scores in found:
                out["query_id"] += [int(own[i])] * len(best)
                out["_q"] += [int(marks[i])] * len(best)
                out["vec_id"] += [int(x) for x in best]
                out["score"] += [int(x) for x in scores]
        return pa.table({name: pa.array(v, pa.int64()) for name, v in out.items()})

    return run


def usable(vector: Column) -> Column:
    good = F.forall(
        vector,
        lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), F.lit(False)),
    )
    return F.coalesce(good, F.lit(False))


def exact_topk(
    embeddings: DataFrame,
    is_query: Column,
    k: int = K,
    scale: int = SCALE,
    block: int = DIMENSIONS,
    candidates_per_cell: int = CANDIDATES_PER_CELL,
    queries_per_cell: int = QUERIES_PER_CELL,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query row its k highest integer inner products."""
    vectors = embeddings.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", is_query.alias("_asks"))
    queries = vectors.filter("_asks").select("vec_id", "embedding", F.xxhash64("embedding").alias("_q"))
    queries = queries.dropDuplicates(["vec_id", "_q"])
    n = vectors.agg(F.count("*"), F.count(F.when(F.col("_asks"), 1))).first()
    rows, cols = (max(1, math.ceil(x / y)) for x, y in zip(n, (candidates_per_cell, queries_per_cell)))
    tasks = min(rows * cols, 20_000)

    def dealt(df: DataFrame, own: str, own_groups: int, other: str, other_groups: int, *more: str) -> DataFrame:
        group = F.pmod(F.xxhash64("vec_id", F.lit(own), *more), F.lit(own_groups)).cast("int")
        copies = F.explode(F.sequence(F.lit(0), F.lit(other_groups - 1)))
        return df.withColumn(own, group).withColumn(other, copies).repartition(tasks, "_c", "_g")

    left = dealt(vectors.select("vec_id", "embedding"), "_c", rows, "_g", cols, "embedding")
    right = dealt(queries, "_g", cols, "_c", rows)
    part = left.groupBy("_c", "_g").cogroup(right.groupBy("_c", "_g")).applyInArrow(
        cell_function(k, scale, block), "query_id long, _q long, vec_id long, score long"
    )
    order = Window.partitionBy("query_id", "_q").orderBy(F.desc("score"), "vec_id")
    ranked = part.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
