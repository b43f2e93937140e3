"""Approximate inner product search with score-aware anisotropic quantisation.

Vectors are cut in pairs of components, each pair coded by one of 16 centroids: four
bits. Codes and codebooks minimise h * (residual along the vector)^2 + (residual
across it)^2 with h > 1, since for the queries that matter, those near a vector,
only the parallel part of the residual changes the score. Codebooks are fitted to a
bounded sample; every row is coded, by coordinate descent on the same loss.

A query's products with all centroids make a table per pair; two tables are joined to
serve a byte of codes at once. Scanning the codes gives approximate scores. The kth best
exact product with a sample, one row in ``SAMPLE_ROWS``, is a score that the kth nearest
row surely reaches. The scan of all rows computes exact products wherever the approximate
score and the most that the row's residual can add reach it. The residual is bounded by
its parts along and across the coded vector, stored with the codes, so no near row is
lost however rows are spread; rows that codes tell apart badly only cost more products.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.vectors import BestSoFar, as_long, best_rows, blocks_of, dimension, distinct_vectors, met, queries_of, ranked, unpack, usable

SAMPLE = 4096  # rows that the codebooks are fitted to at most: those of smallest hash
CENTROIDS = 16
WIDTH = 2  # components coded together
THRESHOLD = 0.2  # cosine above which scores matter; sets the weight of the parallel residual
SAMPLE_ROWS = 8  # one row in so many gives a query its first limit
SLACK = 1e-5  # of the products of lengths: scans sum single-precision numbers


def _padded(x: np.ndarray) -> np.ndarray:
    """Zero components up to a multiple of two pairs, which fill a byte of codes."""
    more = -x.shape[1] % (2 * WIDTH)
    return np.pad(x, ((0, 0), (0, more))) if more else x


class AnisotropicQuantiser:
    def __init__(self, codebooks: np.ndarray, weight: float):
        self.codebooks = codebooks  # (pairs, CENTROIDS, WIDTH)
        self.weight = weight  # of the parallel residual, against 1 across

    @classmethod
    def fit(cls, sample: np.ndarray, rounds: int = 6, weight: float | None = None) -> "AnisotropicQuantiser":
        d = sample.shape[1]
        x = _padded(sample)
        m = x.shape[1] // WIDTH
        share = THRESHOLD**2 / (1 - THRESHOLD**2)
        draw = np.random.default_rng(11)
        parts = x.reshape(len(x), m, WIDTH)
        books = np.stack([parts[draw.integers(0, len(x), CENTROIDS), j] for j in range(m)]) + 1e-6 * draw.standard_normal((m, CENTROIDS, WIDTH))
        made = cls(books, max(1.0, (d - 1) * share) if weight is None else weight)
        u = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).reshape(len(x), m, WIDTH)
        more = made.weight - 1
        for _ in range(rounds):
            codes = np.concatenate([made.encode(x[at : at + 256]) for at in range(0, len(x), 256)])
            parallel = sum(((parts[:, j] - made.codebooks[j][codes[:, j]]) * u[:, j]).sum(1) for j in range(m))
            # one pair after the other: the best centroids while all other pairs stay
            for j in range(m):
                own, along = codes[:, j], u[:, j]
                parallel -= ((parts[:, j] - made.codebooks[j][own]) * along).sum(1)
                wanted = parallel + (parts[:, j] * along).sum(1)
                right = np.stack([np.bincount(own, parts[:, j, a] + more * along[:, a] * wanted, CENTROIDS) for a in range(WIDTH)], 1)
                left = np.stack([np.stack([np.bincount(own, more * along[:, a] * along[:, b] + (a == b), CENTROIDS) for b in range(WIDTH)], 1) for a in range(WIDTH)], 1)
                steady = 1e-6 * np.eye(WIDTH)
                made.codebooks[j] = np.linalg.solve(left + steady, (right + 1e-6 * made.codebooks[j])[:, :, None])[:, :, 0]
                parallel += ((parts[:, j] - made.codebooks[j][own]) * along).sum(1)
        return made

    def encode(self, x: np.ndarray, passes: int = 2) -> np.ndarray:
        """(n, pairs) codes by coordinate descent from the nearest centroids."""
        x = _padded(x)
        n, m = len(x), len(self.codebooks)
        parts = x.reshape(n, m, WIDTH)
        u = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).reshape(n, m, WIDTH)
        across = np.empty((m, n, CENTROIDS))
        along = np.empty((m, n, CENTROIDS))
        for j, book in enumerate(self.codebooks):
            rest = parts[:, j, None, :] - book[None]
            across[j] = (rest**2).sum(2)
            along[j] = (rest * u[:, j, None, :]).sum(2)
        codes = across.argmin(2).T.copy()
        rows = np.arange(n)
        parallel = sum(along[j][rows, codes[:, j]] for j in range(m))
        for _ in range(passes):
            for j in range(m):
                parallel -= along[j][rows, codes[:, j]]
                loss = across[j] + (self.weight - 1) * (parallel[:, None] + along[j]) ** 2
                codes[:, j] = loss.argmin(1)
                parallel += along[j][rows, codes[:, j]]
        return codes.astype(np.uint8)

    def pack(self, codes: np.ndarray) -> np.ndarray:
        """(bytes, n): two codes a byte, one row for each byte position."""
        return np.ascontiguousarray((codes[:, 0::2] | codes[:, 1::2] << 4).T)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """(n, components) coded vectors, padding included."""
        return self.codebooks[np.arange(len(self.codebooks)), codes].reshape(len(codes), -1)

    @property
    def scale(self) -> float:
        """The greatest length of a centroid, which tables are divided by."""
        return float(np.sqrt((self.codebooks**2).sum(2)).max()) or 1.0

    def limits(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """(4, n): what bounds a row's products, see ``reach``: the coded vector's length by the scale, the row's length along
        it and the rest across it, and the row's own length."""
        coded = self.decode(codes) / self.scale
        width = max(coded.shape[1], x.shape[1])
        coded, x = as_long(coded, width), as_long(x, width)
        length, own = np.linalg.norm(coded, axis=1), np.linalg.norm(x, axis=1)
        unit = coded / np.maximum(length, 1e-300)[:, None]
        along = (x * unit).sum(1)
        across = np.linalg.norm(x - along[:, None] * unit, axis=1)
        tiny = length < 1e-20  # single precision knows nothing about its direction
        return np.stack([np.where(tiny, np.inf, length), np.where(tiny, 0.0, along), np.where(tiny, own, across), own])

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(queries, bytes, 256): sums of two products of the query's direction for each byte of codes, by the scale."""
        length = np.linalg.norm(queries, axis=1, keepdims=True)
        q = _padded(queries / np.where(length > 0, length, 1.0)).reshape(len(queries), -1, WIDTH)
        products = np.einsum("qmw,mcw->qmc", q, self.codebooks / self.scale)
        return (products[:, 0::2, None, :] + products[:, 1::2, :, None]).reshape(len(queries), -1, CENTROIDS * CENTROIDS).astype(np.float32)

    def tables_of(self, queries: np.ndarray, at_once: int = 64):
        """The table of each query, some of them made at a time."""
        for at in range(0, len(queries), at_once):
            yield from self.tables(queries[at : at + at_once])


def scan(table: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Approximate scores of all rows for one query."""
    total = np.zeros(packed.shape[1], np.float32)
    for lookup, codes in zip(table, packed):
        total += lookup[codes]
    return total


def reach(scores: np.ndarray, limits: np.ndarray, short: float, length: float) -> np.ndarray:
    """The greatest products that rows of these approximate scores can have with a query of ``length``, ``short`` in the coded components.

    With u along the coded vector, a row is a * u and a rest across u of length b, so its product is at most
    a * (query, u) + b * the query's own length across u.
    """
    coded, along, across, own = limits
    on = np.clip(scores * (short / coded), -length, length)
    return along * on + across * np.sqrt(length * length * (1 + SLACK) - on * on) + SLACK * length * own


def exact_products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products summed from the first component to the last, the same for the same vector."""
    return np.cumsum(vectors * query, axis=1)[:, -1]


def fit_sample(rows: DataFrame, d: int, most: int = SAMPLE) -> np.ndarray:
    """At most ``most`` vectors of ``d`` components, those of smallest hash."""
    some = rows.where(F.size("v") == d).orderBy(F.xxhash64("id"), "id", "v").limit(most).select(F.col("v").cast("array<float>").alias("v")).collect()
    return np.array([r["v"] for r in some], np.float64)


def build_index(rows: DataFrame, books: AnisotropicQuantiser | None, d: int, n: int) -> DataFrame:
    """(ids, data, codes, limits): blocks of all rows with the codes of their vectors and what bounds their products."""

    def coded(vectors, _):
        codes = books.encode(as_long(vectors, d))
        return [books.pack(codes).tobytes(), books.limits(vectors, codes).astype("<f8").tobytes()]

    return blocks_of(rows, d, n, "ann-rows", coded, "codes binary, limits binary")


def nearest_of(query: int, point: np.ndarray, own: np.ndarray, vectors: np.ndarray, found: np.ndarray, k: int, bound: float = -np.inf, slack: float = 0.0):
    """(ids, scores) of the k nearest of the rows ``found``; those that stay below ``bound`` by more than ``slack``, what
    sums in another order may differ by, may be left out."""
    if not len(found):
        return own[:0], np.zeros(0)
    near = vectors[found] @ point if 4 * len(found) < len(own) else (vectors @ point)[found]
    found = found[~(near < bound - slack)]
    if not len(found):
        return own[:0], np.zeros(0)
    distinct, owners = distinct_vectors(own[found], vectors[found], k + 1)
    return best_rows(query, np.arange(len(distinct)), exact_products(distinct, point), owners, k)


def lower_bounds(rows: DataFrame, queries: DataFrame, d: int, n: int, n_queries: int, k: int) -> DataFrame:
    """(id, v, bound): each query with a score that its kth nearest row reaches, minus infinity if a sample of rows gives none.

    Of an id in the sample one vector counts, so that no row counts twice.
    """
    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE_ROWS)) == 0).groupBy("id").agg(F.min("v").alias("v"))

    def sample(batches):
        best: dict = {}
        for batch in batches:
            for ids, data, q_ids, q_data in zip(*(c.to_pylist() for c in batch.columns)):
                own, vectors = unpack(ids, data)
                asked, points = unpack(q_ids, q_data)
                points = as_long(points, vectors.shape[1])
                scores = points @ vectors.T
                # sums in another order differ by less than this
                scores -= 1e-12 * np.linalg.norm(points, axis=1)[:, None] * np.linalg.norm(vectors, axis=1)
                scores[asked[:, None] == own] = -np.inf
                before = best.get(q_ids)
                scores = scores if before is None else np.concatenate([before, scores], 1)
                best[q_ids] = np.partition(scores, scores.shape[1] - k, 1)[:, -k:] if scores.shape[1] > k else scores
        for q_ids, scores in best.items():
            columns = [np.repeat(np.frombuffer(q_ids, "<i8"), scores.shape[1]), scores.ravel()]
            yield pa.record_batch([pa.array(c) for c in columns], names=["query_id", "score"])

    n_some = n // SAMPLE_ROWS + 1
    asked = queries_of(queries, n_queries, "ann-asked")
    pairs = met(blocks_of(some, d, n_some, "ann-sample"), asked, n_some, d, 1)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"))
    found = pairs.mapInArrow(sample, "query_id long, score double").withColumn("nth", F.row_number().over(order)).where(F.col("nth") == k)
    bounded = queries.join(found.select(F.col("query_id").alias("id"), "score"), "id", "left")
    return bounded.select("id", "v", F.coalesce("score", F.lit(float("-inf"))).alias("bound"))


def search(
    df: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every``,
    the k nearest rows found by inner product.

    Rows without an id, and vectors that are null, zero, empty or hold a null or
    non-finite component, take no part. Vectors of different lengths meet in the
    components that both have; codes cover as many as the most frequent length has.
    Ties go to the smaller id. Repeated rows (id and vector) count once; if an id has
    several vectors, its query is the smallest. An empty table gives an empty result;
    other columns are ignored.
    """
    rows = usable(df, id_col, vector_col, zero=False)
    d, n = dimension(rows)
    queries = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    books = AnisotropicQuantiser.fit(fit_sample(rows, d)) if n else None
    index = build_index(rows, books, d, n)
    bounded = lower_bounds(rows, queries, d, n, n // every + 1, k)

    def run(batches):
        best, last = BestSoFar(k), None
        for batch in batches:
            for ids, data, codes, limits, q_ids, q_data, q_bounds in zip(*(c.to_pylist() for c in batch.columns)):
                if (ids, data) != last:
                    last = (ids, data)
                    own, vectors = unpack(ids, data)
                    coded = np.frombuffer(codes, np.uint8).reshape(-1, len(own))
                    limits_here = np.frombuffer(limits, "<f8").reshape(4, -1)
                    longest = limits_here[3].max()
                asked, points = unpack(q_ids, q_data)
                points = as_long(points, vectors.shape[1])
                short, length = (np.linalg.norm(as_long(points, w), axis=1).tolist() for w in (d, vectors.shape[1]))
                bounds = np.frombuffer(q_bounds, "<f8").tolist()
                for k_, (query, point, table) in enumerate(zip(asked.tolist(), points, books.tables_of(as_long(points, d)))):
                    so_far = best.bound(query)
                    bound = bounds[k_] if so_far is None else max(bounds[k_], so_far)
                    found = np.nonzero(~(reach(scan(table, coded), limits_here, short[k_], length[k_]) < bound))[0]
                    some, each = nearest_of(query, point, own, vectors, found, k, bound, 1e-12 * length[k_] * longest)
                    if len(some):
                        best.add(query, some, each)
        yield from best.batches()

    asked = queries_of(bounded, n // every + 1, "ann-queries", lambda _, others: [others[0].astype("<f8").tobytes()], "q_bounds binary")
    found = met(index, asked, n, d).mapInArrow(run, "query_id long, vec_id long, score double")
    return ranked(found, k).select(F.col("query_id").cast("long"), F.col("rank").cast("int"), "vec_id", "score")
