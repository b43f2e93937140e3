"""Quality by Bradley-Terry ranking.

Each document has a vector of features: shares of character classes, word and line
statistics, how well the text compresses, and hashed trigrams of character shapes
(letters, digits and spaces count as one shape each, every symbol as its own), so that
marks, markup and their places are learned and not listed. Pairs of a preferred and a
rejected document are made within blocks of all labelled documents; logistic loss on the difference
of their features learns a strength per feature, so that a document's score ranks it
among all others. The score's threshold is the quantile that leaves as large a share
below it as the labels have rejected documents: the classes are weighted by
their number among all labels that may be learned from. A logistic curve centred there,
as steep as fits the weighted labels best, maps scores to 0..1.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, give_back, held_out, map_texts, materialize, portions, text_column, trim

PAIRS = 20_000  # preference pairs that ``fit`` draws from rows given as a list
BLOCK = 4096  # labelled documents that meet in one block
BINS = 4096  # ranges of scores in each step towards the threshold
BUCKETS = 128  # of hashed trigrams

_KIND = np.zeros(256, np.int64)  # 0 other ASCII, 1 lower, 2 upper, 3 digit, 4 space, 5 sentence mark, 6 symbol, 7 beyond ASCII
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = (
        7 if _b >= 128 else 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 4 if _c.isspace()
        else 5 if _c in ".,;:'\"-()" else 6
    )
_KINDS = np.eye(8)[_KIND]


# the shape of a byte: one for all letters in lower case, one in upper case, one for digits and spaces each, else the byte itself
_SHAPE = np.arange(256, dtype=np.uint32)
for _kind, _as in ((1, ord("a")), (2, ord("A")), (3, ord("0")), (7, ord("a"))):
    _SHAPE[_KIND == _kind] = _as


def shape_trigrams(raw: np.ndarray) -> np.ndarray:
    """Shares of the hashed trigrams of a text's shapes, runs of one shape shortened to two."""
    shapes = _SHAPE[raw]
    if len(shapes) > 2:
        shapes = shapes[np.concatenate([[True, True], (shapes[2:] != shapes[1:-1]) | (shapes[1:-1] != shapes[:-2])])]
    if len(shapes) < 3:
        return np.zeros(BUCKETS)
    codes = (shapes[:-2] << np.uint32(16) | shapes[1:-1] << np.uint32(8) | shapes[2:]) * np.uint32(0x9E3779B1)
    return np.bincount(codes >> np.uint32(32 - BUCKETS.bit_length() + 1), minlength=BUCKETS) / len(codes)


def features(text: str) -> np.ndarray:
    """Features of a whole text: character classes, word shapes, repetition, lines, compression, shape trigrams."""
    data = text.encode()
    raw = np.frombuffer(data, np.uint8)
    kinds = np.bincount(raw, minlength=256) @ _KINDS
    n = max(1, len(raw))
    words = text.split()
    w = max(1, len(words))
    lines = text.split("\n")
    letters = max(1.0, kinds[1] + kinds[2] + kinds[7])
    distinct = len(set(words)) / w
    shares = np.sqrt(kinds / n)
    packed = len(zlib.compress(data, 1)) / (n + 20)
    return np.concatenate([
        shares, [
            np.log1p(n), np.log1p(w), kinds[2] / letters, np.log1p(kinds[6] / w), np.log1p(n / w), distinct, distinct * np.log1p(w),
            len(set(lines)) / len(lines), np.log1p(len(lines)), np.log1p(len(lines) * 20 / w), packed, packed * np.log1p(n), 1 / w,
        ], np.sqrt(shape_trigrams(raw)),
    ])


@dataclass(frozen=True)
class QualityModel:
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    strength: tuple[float, ...]
    threshold: float
    slope: float

    def ranks(self, x: np.ndarray) -> np.ndarray:
        return (x - np.array(self.mean)) / np.array(self.scale) @ np.array(self.strength)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.ranks(x) - self.threshold), -50, 50)))


def bradley_terry(good: np.ndarray, bad: np.ndarray, l2: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Strengths that minimise the mean of log(1 + exp(-(good - bad) @ w)), by Newton's method."""
    diff = good - bad
    w = np.zeros(diff.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))  # of the wrong order
        grad = -diff.T @ p / len(diff) + l2 * w
        hess = (diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + l2 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        size = np.abs(step).max()
        w -= step * min(1.0, 2.0 / max(size, 1e-9))
        if size < 1e-4:
            break
    return w


def fit(rows: list[tuple[int, int, str]], share_rejected: float | None = None, n_pairs: int = PAIRS) -> QualityModel:
    """A model of (id, quality 0 or 1, text) rows; ``share_rejected`` is the share of rejected
    documents where the rows come from, that among the rows if none is given. Without rows of
    both classes every text gets the same score: near 0 if only rejected rows are known, else near 1."""
    y = np.array([q for _, q, _ in rows])
    if len(set(y)) < 2:
        d = len(features(""))
        return QualityModel((0.0,) * d, (1.0,) * d, (0.0,) * d, 50.0 if len(y) and not y[0] else -50.0, 1.0)
    x = np.array([features(t) for _, _, t in rows])
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    z = (x - mean) / scale
    good, bad = np.nonzero(y == 1)[0], np.nonzero(y == 0)[0]
    draw = np.random.default_rng(7)
    w = bradley_terry(z[draw.choice(good, n_pairs)], z[draw.choice(bad, n_pairs)])
    s = z @ w
    share = len(bad) / len(y) if share_rejected is None else share_rejected
    weight = np.where(y == 1, (1 - share) / len(good), share / len(bad))
    order = np.argsort(s, kind="stable")
    k = int(np.clip(np.searchsorted(weight[order].cumsum(), share - 1e-9) + 1, 1, len(s) - 1))
    threshold = float((s[order[k - 1]] + s[order[k]]) / 2)
    signed = np.where(y == 1, -1, 1)
    slope = min(np.geomspace(0.05, 20, 60), key=lambda a: np.logaddexp(0, signed * np.clip(a * (s - threshold), -500, 500)) @ weight)
    return QualityModel(tuple(mean), tuple(scale), tuple(w), threshold, float(slope))


def _blocks(docs: DataFrame, labels: DataFrame, rows_each: int, least: int = 16) -> DataFrame:
    """(block, good, bad): the features of all labelled documents that are not held out, as bytes of float32, about ``rows_each`` of them a block.

    Documents are dealt to blocks by the hash of their id. A class with fewer than ``least`` rows a block is repeated in several blocks, so
    that every block has rows of both to pair. Of repeated rows of an id one text counts (the smallest hash); an id labelled both ways counts once a label.
    """
    ids = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_y")).where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & ~held_out(F.col("_id"))).distinct()
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("_t")).where(F.col("_t").isNotNull())
    # features leave at once, so texts are neither shuffled nor kept
    kind = texts.schema["_id"].dataType.simpleString()

    def described(batches):
        for batch in batches:
            for part in portions(batch, 1, 2_000_000):
                found = [features(t).astype("<f4").tobytes() for t in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(found, pa.binary()), part.column(2)], names=["_id", "x", "_h"])

    x = texts.where(~held_out(F.col("_id"))).withColumn("_h", F.xxhash64("_t")).mapInArrow(lambda batches: give_back(described(batches)), f"_id {kind}, x binary, _h long")
    x = materialize(x.groupBy("_id").agg(F.min_by("x", F.struct("_h", "x")).alias("x")).join(ids, "_id"), "quality-features")
    counts = {r["_y"]: r["n"] for r in x.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    n = max(1, -(-sum(counts.values()) // rows_each))
    copies = {y: min(n, -(-least * n // c)) for y, c in counts.items()}
    each = F.when(F.col("_y") == 1, copies.get(1, 1)).otherwise(copies.get(0, 1))
    nth = F.explode(F.sequence(F.lit(0), each - 1)).alias("k")
    dealt = x.select("_y", "_id", "x", each.alias("each"), nth).withColumn("block", F.pmod(F.xxhash64("_id") + F.floor(F.col("k") * n / F.col("each")), F.lit(n)))

    def gathered(table: pa.Table) -> pa.Table:
        order = table.sort_by([("_id", "ascending")])
        of = lambda y: b"".join(v for v, c in zip(order["x"].to_pylist(), order["_y"].to_pylist()) if c == y)
        return pa.table({"block": order["block"][:1], "good": pa.array([of(1)], pa.binary()), "bad": pa.array([of(0)], pa.binary()), "once": pa.array([[copies.get(0, 1), copies.get(1, 1)]], pa.list_(pa.int64()))})

    blocks = materialize(dealt.groupBy("block").applyInArrow(gathered, "block long, good binary, bad binary, once array<long>"), "quality-blocks")
    discard(x)
    return blocks


def _total(blocks: DataFrame, part):
    """The sum over all blocks of ``part(good, bad, weights of a row of each)``, an array, added up in the tasks and in a tree of them."""
    d = len(features(""))

    def run(rows):
        held = None
        for r in rows:
            bad, good = (np.frombuffer(r[c], "<f4").reshape(-1, d).astype(float) for c in ("bad", "good"))
            value = part(good, bad, 1 / r["once"][1], 1 / r["once"][0])
            held = value if held is None else held + value
        return [] if held is None else [held]

    return blocks.rdd.mapPartitions(run).treeReduce(lambda a, b: a + b)


def _pairs(good: np.ndarray, bad: np.ndarray, each: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs in which every row of the larger side stands ``each`` times, and the smaller side's rows evenly."""
    n = max(len(good), len(bad))
    k = np.arange(each * n if len(good) and len(bad) else 0)
    shift = k // n * max(1, min(len(good), len(bad), 2) - 1)  # other partners the second time
    wide, narrow = k % n, (k + shift) % max(1, min(len(good), len(bad)))
    return (wide, narrow) if len(good) >= len(bad) else (narrow, wide)


def _quantile(total, share: float) -> float:
    """The middle between the two neighbouring scores where the weights up to the lower one first reach ``share``. ``total(edges)`` gives, for
    the ranges between edges and over all rows, weights and least scores; ranges are narrowed until one holds a single score."""
    lo, hi = total(None)
    below, above = 0.0, hi
    if lo == hi:
        return lo
    while True:
        edges = np.linspace(lo, hi, BINS + 1)
        edges[-1] = hi
        weight, least, most = total(edges)
        upto = below + weight.cumsum()
        filled = np.nonzero(weight > 0)[0]
        at = filled[min(int(np.searchsorted(upto[filled], share - 1e-9)), len(filled) - 1)]
        later = filled[filled > at]
        above = least[later[0]] if len(later) else above
        if least[at] == most[at]:
            return float((least[at] + above) / 2)
        below, lo, hi = (upto[at - 1] if at else below), least[at], most[at]


def train(docs: DataFrame, labels: DataFrame, block: int = BLOCK) -> QualityModel:
    """Fit on all labelled documents that are not held out; rows meet in blocks, and sums over all blocks give each step of Newton's method."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    share = known.select("doc_id", "quality").distinct().agg(F.avg((F.col("quality") == 0).cast("int"))).first()[0]
    blocks = _blocks(docs, labels, block)
    sizes = blocks.agg(F.coalesce(F.sum(F.octet_length("good")), F.lit(0)), F.coalesce(F.sum(F.octet_length("bad")), F.lit(0))).first()
    if not all(sizes):
        discard(blocks)
        return fit([(0, y, "") for y, n in ((1, sizes[0]), (0, sizes[1])) if n])
    moments = lambda x, w: w * np.stack([np.full(x.shape[1], len(x)), x.sum(0), (x * x).sum(0)])
    sums = _total(blocks, lambda g, b, wg, wb: np.stack([moments(g, wg), moments(b, wb)]))
    n_good, n_bad = sums[0, 0, 0], sums[1, 0, 0]
    n, first, second = sums.sum(0)
    mean = first / n
    scale = np.sqrt(np.maximum(second / n - mean**2, 0))
    scale[scale < 1e-6] = 1.0  # of float32
    w = np.zeros(len(mean))
    for _ in range(30):

        def step_of(g, b, wg, wb, w=w):
            i, j = _pairs(g, b)
            diff = (g[i] - b[j]) / scale
            p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
            hess = (diff * (p * (1 - p))[:, None]).T @ diff
            return np.vstack([hess, -diff.T @ p, np.full(len(w), len(diff))])

        found = _total(blocks, step_of)
        pairs = max(1.0, found[-1, 0])
        step = np.linalg.solve(found[:-2] / pairs + 1e-3 * np.eye(len(w)), found[-2] / pairs + 1e-3 * w)
        size = np.abs(step).max()
        w = w - step * min(1.0, 2.0 / max(size, 1e-9))
        if size < 1e-4:
            break
    ranks = lambda x: (x - mean) / scale @ w
    good_w, bad_w = (1 - share) / n_good, share / n_bad

    def total(edges):
        if edges is None:
            ends = blocks.rdd.map(lambda r: [v for c in ("good", "bad") if r[c] for s in [ranks(np.frombuffer(r[c], "<f4").reshape(-1, len(mean)).astype(float))] for v in (s.min(), s.max())])
            return ends.map(lambda v: (min(v), max(v))).treeReduce(lambda a, b: (min(a[0], b[0]), max(a[1], b[1])))

        def counted(r):
            weight, least, most = np.zeros(BINS), np.full(BINS, np.inf), np.full(BINS, -np.inf)
            for c, each in (("good", good_w / r["once"][1]), ("bad", bad_w / r["once"][0])):
                s = ranks(np.frombuffer(r[c], "<f4").reshape(-1, len(mean)).astype(float))
                s = s[(s >= edges[0]) & (s <= edges[-1])]
                at = np.minimum(np.searchsorted(edges, s, "right") - 1, BINS - 1)
                np.add.at(weight, at, each)
                np.minimum.at(least, at, s)
                np.maximum.at(most, at, s)
            return weight, least, most

        return blocks.rdd.map(counted).treeReduce(lambda a, b: (a[0] + b[0], np.minimum(a[1], b[1]), np.maximum(a[2], b[2])))

    threshold = _quantile(total, share)
    slopes = np.geomspace(0.05, 20, 60)

    def losses(g, b, wg, wb):
        loss = lambda x, sign, each: np.array([each * np.logaddexp(0, sign * np.clip(a * (x - threshold), -500, 500)).sum() for a in slopes])
        return loss(ranks(g), -1, wg * good_w) + loss(ranks(b), 1, wb * bad_w)

    slope = slopes[int(np.argmin(_total(blocks, losses)))]
    discard(blocks)
    trim()
    return QualityModel(tuple(map(float, mean)), tuple(map(float, scale)), tuple(map(float, w)), threshold, float(slope))


def score_documents(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for every row of ``docs``, over whole texts.

    Null texts score like empty ones. Copies share their score. Rows with a null id
    are scored like any other; an empty table gives an empty result; other columns
    are ignored.
    """

    def score(texts):
        s = model.scores(np.array([features(t) for t in texts]))
        return [pa.array(s), pa.array((s >= 0.5).astype(np.int32))]

    return map_texts(docs, id_col, text_col, score, "score double, predicted int")


def predicted(model: QualityModel):
    """A column function: 1 for texts above the threshold, else 0; null texts count as empty."""
    return text_column(lambda texts: (model.scores(np.array([features(t) for t in texts])) >= 0.5).astype(np.int32), "int")


def op5_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_documents(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
