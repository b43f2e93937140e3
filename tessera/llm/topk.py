"""Exact top-k inner product search by the threshold algorithm.

Each block of vectors keeps, for every dimension, its rows sorted by that component. A
query walks the lists from the top for a positive weight and from the bottom for a
negative one, and scores each row when it first meets it. A row not met yet can score
no more than the weighted sum of the components at the lists' current depths; when that
is below the score of the kth best row, the walk ends. In each step those lists advance
whose next entries lower that sum most. The kth best score so far goes from block to
block within a task, so later walks end earlier; a block whose best possible sum is
below it is skipped.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.vectors import BestSoFar, as_long, best_rows, blocks_of, dimension, distinct_vectors, met, queries_of, ranked, unpack, usable

SCALE = 1024
STEP = 16  # entries of a list that the first step reads; each step reads twice as many as the one before, up to an eighth of the list


class SortedLists:
    """The per-dimension lists of one block of integer vectors."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.largest = int(np.abs(vectors).max(initial=0))
        self.floats = vectors.astype(np.float64)
        self.order = np.ascontiguousarray(np.argsort(vectors, axis=0, kind="stable").T)  # a list a row
        self.sorted = np.take_along_axis(np.ascontiguousarray(vectors.T), self.order, axis=1)

    def search(self, query: np.ndarray, k: int, bound: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the rows met: all with one of the k best scores that are ``bound`` or more are among them."""
        n = len(self.vectors)
        used = np.nonzero(query)[0]
        weights = query[used]
        if not len(used) or not n:
            return np.arange(n), np.zeros(n, np.int64)
        exact = self.largest * int(np.abs(query).max()) * len(query) < 1 << 53
        vectors, q = (self.floats, query.astype(np.float64)) if exact else (self.vectors, query)
        up, at = weights > 0, np.arange(len(used))
        depth = np.zeros(len(used), np.int64)
        # what each list can still add at a depth; below the list's end nothing is left unmet
        edge = lambda d: weights * self.sorted[used, np.where(up, n - 1 - np.minimum(d, n - 1), np.minimum(d, n - 1))]
        now = edge(depth)
        seen = np.zeros(n, bool)
        found, scores, held, step = [], [], np.zeros(0, np.int64), STEP
        while bound is None or now.sum() >= bound:
            ahead = edge(depth + step)
            drop = now - ahead
            chosen = at[drop >= np.partition(drop, len(used) // 2)[len(used) // 2]]
            places = np.minimum(depth[chosen, None] + np.arange(step), n - 1)
            rows = self.order[used[chosen, None], np.where(up[chosen, None], n - 1 - places, places)]
            fresh = np.zeros(n, bool)
            fresh[rows.ravel()] = True
            fresh &= ~seen
            seen |= fresh
            new = np.flatnonzero(fresh)
            if len(new):
                found.append(new)
                scores.append((vectors[new] @ q).astype(np.int64))
                held = np.concatenate([held, scores[-1]])
                if len(held) > k:
                    held = np.partition(held, len(held) - k)[len(held) - k :]
                if len(held) == k:
                    bound = int(held.min()) if bound is None else max(bound, int(held.min()))
            depth[chosen] += step
            now[chosen] = ahead[chosen]
            step = max(STEP, min(2 * step, n // 8))
            if seen.all():
                break
        return (np.concatenate(found), np.concatenate(scores)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def search(df: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every``,
    the k rows with the largest inner product of vectors floor(1024 * x).

    Rows without an id, and vectors that are null or hold a null or non-finite component,
    take no part. Vectors of different lengths meet in the components that both have; an
    empty vector's products are zero. Ties go to the smaller id. Repeated rows (id and
    vector) count once; if an id has several vectors, its query is the smallest. An empty
    table gives an empty result, other columns are ignored. Products are exact while they
    fit 64 bits.
    """
    rows = usable(df, id_col, vector_col, zero=True)
    d, n = dimension(rows)
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(SCALE * x).cast("double")))
    queries = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))

    def run(batches):
        best, last, lists, owners = BestSoFar(k), None, None, []
        for batch in batches:
            for ids, data, q_ids, q_data in zip(*(c.to_pylist() for c in batch.columns)):
                if (ids, data) != last:
                    last = (ids, data)
                    vectors, owners = distinct_vectors(*unpack(ids, data), k + 1)
                    lists = SortedLists(vectors.astype(np.int64))
                asked, weights = unpack(q_ids, q_data)
                weights = as_long(weights, lists.vectors.shape[1]).astype(np.int64)
                for query, w in zip(asked.tolist(), weights):
                    # k + 1, as the query's own vector is among them
                    found, scores = lists.search(w, k + 1, best.bound(query))
                    some, each = best_rows(query, found, scores, owners, k)
                    best.add(query, some, each)
        yield from best.batches()

    blocks = blocks_of(rows, d, n, "topk-rows")
    asked = queries_of(queries, n // every + 1, "topk-queries")
    found = met(blocks, asked, n, d).mapInArrow(run, "query_id long, vec_id long, score long")
    return ranked(found, k).select(F.col("query_id").cast("long"), F.col("rank").cast("int"), "vec_id", "score")
