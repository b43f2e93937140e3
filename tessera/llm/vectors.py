"""Vectors packed in blocks, for searches of a stated query set against all rows.

Rows are dealt out evenly, whatever their values, and each task packs what it gets
in blocks of bounded bytes. Blocks of candidates meet blocks of queries; a pair of
blocks is one row, the unit in which a search runs in Python.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize

BLOCK_BYTES = 1 << 20
QUERY_ROWS = 256


def usable(df: DataFrame, id_col: str, vector_col: str, zero: bool) -> DataFrame:
    """(id, v array<double>) of rows that can take part: an id, and a vector that is not
    null and holds only finite components; without ``zero``, one component other than zero."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad)
    return rows if zero else rows.where(F.exists("v", lambda x: x != 0))


def dimension(rows: DataFrame) -> tuple[int, int]:
    """(length, rows): the most frequent vector length, the shorter on a tie, and the number of rows; (0, 0) without rows."""
    found = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d")
    most = found.first()
    return (most["d"], found.agg(F.sum("count")).first()[0]) if most else (0, 0)


def packed(rows: DataFrame, tag: str, most_rows: int, more=None, schema: str = "") -> DataFrame:
    """(ids binary, data binary, ...): blocks of rows (id, v, ...) of one length, at most ``BLOCK_BYTES``
    and ``most_rows`` large (one row at least), written to the shared folder. ``more(vectors, others)``
    gives the block's columns of ``schema``; ``others`` are arrays of the columns after v."""
    extra = [c.split()[0] for c in schema.split(", ") if c]

    def run(batches):
        held: dict = {}

        def block(d, take):
            ids, flat, others = held[d]
            data = np.array(flat[:take], "<f8").reshape(take, d)
            columns = [np.array(ids[:take], "<i8").tobytes(), data.tobytes(), *(more(data, [o[:take] for o in others]) if more else ())]
            held[d] = (ids[take:], flat[take:], [o[take:] for o in others])
            return pa.record_batch([pa.array([c], pa.binary()) for c in columns], names=["ids", "data", *extra])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(batch.column(1).value_lengths().to_numpy(zero_copy_only=False))])
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            others = [c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]]
            for d in np.unique(np.diff(starts)).tolist():
                own = np.nonzero(np.diff(starts) == d)[0]
                vectors = flat[starts[own][:, None] + np.arange(d)]
                before = held.get(d, (np.zeros(0, np.int64), np.zeros((0, d)), [o[:0] for o in others]))
                held[d] = (np.concatenate([before[0], ids[own]]), np.concatenate([before[1], vectors]), [np.concatenate([o, x[own]]) for o, x in zip(before[2], others)])
                size = max(1, min(most_rows, BLOCK_BYTES // (8 * max(1, d))))
                while len(held[d][0]) >= size:
                    yield block(d, size)
        for d in list(held):
            if len(held[d][0]):
                yield block(d, len(held[d][0]))

    return materialize(rows.mapInArrow(run, "ids binary, data binary" + (", " + schema if schema else "")), tag)


def unpack(ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.frombuffer(ids, "<i8")
    return numbers, np.frombuffer(data, "<f8").reshape(len(numbers), -1)


def as_long(x: np.ndarray, d: int) -> np.ndarray:
    """Vectors of ``d`` components: the first ones, and zeros where there are fewer."""
    return x[:, :d] if x.shape[1] >= d else np.pad(x, ((0, 0), (0, d - x.shape[1])))


def blocks_of(rows: DataFrame, d: int, n: int, tag: str, more=None, schema: str = "") -> DataFrame:
    size = max(1, BLOCK_BYTES // (8 * max(1, d)))
    return packed(rows.repartition(max(1, -(-n // (8 * size)))), tag, size, more, schema)


def queries_of(queries: DataFrame, n: int, tag: str, more=None, schema: str = "") -> DataFrame:
    """Blocks of (id, v, ...) queries, their columns named ``q_ids``, ``q_data`` and as in ``schema``."""
    asked = packed(queries.repartition(max(1, -(-n // (8 * QUERY_ROWS)))), tag, QUERY_ROWS, more, schema)
    return asked.withColumnsRenamed({"ids": "q_ids", "data": "q_data"})


def met(blocks: DataFrame, asked: DataFrame, n: int, d: int, a_task: int = 4) -> DataFrame:
    """Every block of rows with every block of queries, ``a_task`` blocks of rows a task: a stated query
    set against all rows, in blocks. Spark broadcasts the queries only below its size threshold."""
    return blocks.repartition(max(8, n // (a_task * max(1, BLOCK_BYTES // (8 * max(1, d)))))).crossJoin(asked)


def distinct_vectors(ids: np.ndarray, data: np.ndarray, most: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The different vectors of a block, each with its ``most`` smallest different ids,
    ascending: all that a search for the ``most`` best rows can need of copies."""
    order = np.argsort(ids, kind="stable")
    ids, data = ids[order], np.ascontiguousarray(data[order]) + 0.0  # no negative zero
    if not data.shape[1]:
        return data[:1], [np.unique(ids)[:most]]
    _, first, back = np.unique(data.view(f"V{data.itemsize * data.shape[1]}").ravel(), return_index=True, return_inverse=True)
    by = np.argsort(back, kind="stable")
    groups = np.split(ids[by], np.cumsum(np.bincount(back))[:-1])
    return data[first], [np.unique(g)[:most] for g in groups]


def best_rows(query: int, found: np.ndarray, scores: np.ndarray, owners: list[np.ndarray], k: int):
    """(ids, scores) of the k best rows among distinct vectors ``found``, the query's own id left out."""
    counts = [len(owners[g]) for g in found]
    ids = np.concatenate([owners[g] for g in found]) if len(found) else np.zeros(0, np.int64)
    each = np.repeat(scores, counts)
    keep = ids != query
    ids, each = ids[keep], each[keep]
    order = np.lexsort((ids, -each))[:k]
    return ids[order], each[order]


class BestSoFar:
    """The k best rows of each query over all blocks that a task has met, so that its
    output doesn't grow with their number."""

    def __init__(self, k: int):
        self.k, self.held = k, {}

    def bound(self, query: int):
        """The kth best score so far, None before there are k."""
        found = self.held.get(query)
        return found[1][-1] if found is not None and len(found[1]) == self.k else None

    def add(self, query: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if query in self.held:
            ids, scores = (np.concatenate(pair) for pair in zip(self.held[query], (ids, scores)))
            order = np.lexsort((ids, -scores))
            ids, scores = ids[order], scores[order]
            # a repeated row may lie in several blocks
            new = np.append(True, (ids[1:] != ids[:-1]) | (scores[1:] != scores[:-1]))[: len(ids)]
            ids, scores = ids[new][: self.k], scores[new][: self.k]
        self.held[query] = (ids, scores)

    def batches(self):
        """Record batches (query_id, vec_id, score) of some thousand queries each."""
        queries = list(self.held)
        for at in range(0, len(queries), 2000):
            part = queries[at : at + 2000]
            found = [self.held[q] for q in part]
            owner = np.repeat(np.array(part, np.int64), [len(ids) for ids, _ in found])
            columns = [owner, np.concatenate([ids for ids, _ in found]), np.concatenate([scores for _, scores in found])]
            yield pa.record_batch([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])


def ranked(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of what the blocks found, ties to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    rows = found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return rows.select("query_id", "rank", "vec_id", "score")
