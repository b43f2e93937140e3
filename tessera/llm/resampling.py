"""Importance resampling towards a target distribution.

A document's features are its runs of one to three words, hashed by crc32 into buckets.
The counts of the buckets in all documents and in all target texts are added up per task
first and reach the driver as one row a bucket; a bucket's gain is the logarithm of how much
more frequent it is in the target. Weights are array lookups of gains, summed over a
document's features. With a Gumbel noise drawn from a hash of the document's id, the
highest scores are a sample without replacement in proportion to the weights.

The draw never sorts the documents. Scores are integers. A histogram of score ranges, of
at most ``RANGES`` rows whatever the number of documents, finds the range of the cutoff; the
histogram of the scores from there on, summed from the top, gives each score its first
rank and the cutoff score. Only documents of these ranges are shuffled, by score, and numbered
by id within it.

Hashing. crc32 is linear: the sum of "a b" is the sum of "a", shifted by the length of " b",
exclusive-or the sum of " b". Sums of words are kept, and shifts are four table lookups, so
pairs and triples of words are hashed as arrays.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import map_texts, materialize, portions

BUCKETS = 10_000
ORDERS = 3  # words of the longest feature
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
RANGES = 65_536  # rows of the first histogram at most
WORDS_KEPT = 300_000  # words whose sums a task keeps
SHORT = 63  # bytes of the longest shift with a table
# Lower-cases A-Z and turns every ASCII byte but digits and letters into a space.
_TRANSLATE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The lower-cased runs of ASCII letters, digits and non-ASCII characters of a text, as UTF-8."""
    return (text or "").encode().translate(_TRANSLATE).split()


def _shift_tables(longest: int) -> np.ndarray:
    """Flat (length, place, byte) table: the crc32 register after ``length`` zero bytes, for each byte at each of its four places."""
    step = np.array([zlib.crc32(bytes([b])) for b in range(256)], np.uint32) ^ np.uint32(zlib.crc32(b"\0"))
    step ^= step[0]
    now = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    out = [now]
    for _ in range(longest):
        now = (now >> np.uint32(8)) ^ step[now & np.uint32(255)]
        out.append(now)
    return np.stack(out).ravel()


class FeatureHasher:
    """Buckets of the features of many texts at once."""

    def __init__(self, buckets: int = BUCKETS, orders: int = ORDERS):
        self.buckets, self.orders = buckets, orders
        self.tables = _shift_tables(SHORT)
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.words: list[bytes] = []
        self.alone, self.after, self.size = (np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int32))

    def _learn(self, words: list[bytes]) -> None:
        known = len(self.words)
        for word in words:
            if word not in self.numbers:
                self.numbers[word] = len(self.words)
                self.words.append(word)
        while len(self.words) > len(self.alone):
            self.alone, self.after, self.size = (np.concatenate([a, np.zeros_like(a)]) for a in (self.alone, self.after, self.size))
        for k in range(known, len(self.words)):
            word = self.words[k]
            self.alone[k], self.after[k], self.size[k] = zlib.crc32(word), zlib.crc32(b" " + word), len(word) + 1

    def _extended(self, sums: np.ndarray, nexts: np.ndarray) -> np.ndarray:
        """Sums of texts, each followed by a space and its next word."""
        size, tables = self.size[nexts], self.tables
        base = np.minimum(size, SHORT) * 1024
        out = self.after[nexts].copy()
        for k in range(4):
            out ^= tables[base + (256 * k) + (sums >> np.uint32(8 * k) & np.uint32(255)).astype(np.int32)]
        for k in np.nonzero(size > SHORT)[0]:
            out[k] = zlib.crc32(b" " + self.words[nexts[k]], int(sums[k]))
        return out

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """(words of each text, buckets of the features of each order, text of each of these)."""
        if len(self.words) > WORDS_KEPT:
            self._forget()
        found = [words_of(t) for t in texts]
        counts = np.array([len(w) for w in found], np.int64)
        flat: list[bytes] = [w for words in found for w in words]
        numbers = list(map(self.numbers.get, flat))
        if None in numbers:
            self._learn([w for w, n in zip(flat, numbers) if n is None])
            numbers = list(map(self.numbers.get, flat))
        ids, owner = np.array(numbers, np.int64), np.repeat(np.arange(len(texts)), counts)
        buckets, owners = [], []
        sums = self.alone[ids]
        for order in range(self.orders):
            if order:
                sums = self._extended(sums[:-1], ids[order:])
            whole = owner[: len(sums)] == owner[order:]
            buckets.append((sums % np.uint32(self.buckets))[whole].astype(np.int64))
            owners.append(owner[: len(sums)][whole])
            if not len(sums):
                break
        return counts, buckets, owners


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, orders: int = ORDERS) -> np.ndarray:
    """Features of all texts by bucket. Null texts have none. ``buckets`` rows reach the driver."""

    def run(batches):
        hasher, total = FeatureHasher(buckets, orders), np.zeros(buckets, np.int64)
        for batch in batches:
            for part in portions(batch, 0, 1_000_000):
                for found in hasher(part.column(0).to_pylist())[1]:
                    total += np.bincount(found, minlength=buckets)
        at = np.nonzero(total)[0]
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    counted = texts.select(F.col(text_col).cast("string").alias("_t")).mapInArrow(run, "bucket long, n long")
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed ratio of the target's share of each bucket to the documents' share."""
    n = len(documents)
    s_all, t_all = float(documents.sum() + n), float(target.sum() + n)
    each = zip(documents.tolist(), target.tolist())
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in each], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", orders: int = ORDERS) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row; ``gain`` is one number a bucket."""
    state: list[FeatureHasher] = []

    def score(texts):
        if not state:
            state.append(FeatureHasher(len(gain), orders))
        counts, buckets, owners = state[0](texts)
        features, weights = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for found, owner in zip(buckets, owners):
            own = np.bincount(owner, minlength=len(texts))
            upto = np.concatenate([[0], np.cumsum(gain[found])])
            ends = np.cumsum(own)
            features += own
            weights += upto[ends] - upto[ends - own]
        return [pa.array(counts), pa.array(features), pa.array(weights)]

    return map_texts(docs, id_col, text_col, score, "n_words long, n_features long, weight long", 1_000_000)


def with_noise(weighed: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds score: the weight and floor(1000 times) a Gumbel number drawn by a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return weighed.withColumn("score", F.col("weight") + gumbel)


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, ranges: int = RANGES) -> DataFrame:
    """Adds rank to ``scored(doc_id, n_words, score)``: 1, 2, ... for the ``percent`` highest scores of the rows with
    ``least_words`` words, ties by id; null for the others. ``scored`` is read several times: pass a written table.
    """
    spark = scored.sparkSession
    able = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    n, low, high = scored.where(able).agg(F.count("score"), F.min("score"), F.max("score")).first()
    wanted = n * percent // 100
    if not wanted:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    shift = max(0, (high - low).bit_length() - (ranges.bit_length() - 1))
    in_range = F.shiftright(F.col("score") - low, shift)
    above, first, cut = 0, [], None
    for row in sorted(scored.where(able).groupBy(in_range.alias("range")).count().collect(), key=lambda r: -r["range"]):
        if above >= wanted:
            break
        first.append((row["range"], above))
        above, cut = above + row["count"], row["range"]
    reached = F.coalesce(able & (F.col("score") >= low + (cut << shift)), F.lit(False))
    upper, rest = scored.where(reached), scored.where(~reached)
    # the histogram of the scores from the cutoff's range on, each with the number of rows above it
    exact = upper.groupBy("score").agg(F.count("score").alias("n")).withColumn("range", in_range)
    higher = Window.partitionBy("range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    exact = exact.withColumn("higher", F.coalesce(F.sum("n").over(higher), F.lit(0)))
    # a row a range, ``ranges`` at most, which bounds this broadcast
    exact = exact.join(F.broadcast(spark.createDataFrame(first, "range long, above long")), "range")
    exact = exact.select("score", (F.col("above") + F.col("higher")).alias("before")).where(F.col("before") < wanted)
    nth = F.row_number().over(Window.partitionBy("score").orderBy("doc_id"))
    ranked = upper.join(exact, "score", "left").withColumn("rank", F.col("before") + nth)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")).cast("long"))
    return ranked.select(*scored.columns, "rank").unionByName(rest.withColumn("rank", F.lit(None).cast("long")))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, orders: int = ORDERS, seed: int = SEED,
    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of ``docs``.

    Null texts, of documents or target, have no features; a document without features weighs
    zero. An empty target or table of documents counts zero in every bucket. A row with a null
    id has no noise, hence no score, and is never drawn. Repeated rows count and are
    drawn as often as they occur, with ranks one after another. Columns besides the named ones
    are ignored.
    """
    gain = gains(bucket_counts(docs, text_col, buckets, orders), bucket_counts(target, target_col, buckets, orders))
    scored = materialize(with_noise(weigh(docs, gain, id_col, text_col, orders), seed), "resampling-scores")
    return draw(scored, percent, least_words)
