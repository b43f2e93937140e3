"""Periodic runs of words within documents.

A run is a stretch of words with smallest period q, at least ``least`` words and ``2 * q`` words long, that no
neighbouring word extends keeping period q. The parts of a run that lie q apart overlap in itself:
its first ``length - q`` words occur again q words later, and together the two occurrences are the
whole run. ``length - q`` is at least ``max(least, 2 * q) - q``, which is least for ``q = least / 2``.
With k that minimum, every word of a run stands in a k-gram that its document repeats. Words
outside such k-grams are masked; they can't join a run, and what survives are segments that
hold every run whole. In ordinary prose little survives.

Main-Lorentz on the segments: halve a segment again and again. A run that crosses a middle
has a full period on one side of it; for each period, how far the words q apart agree to the
left and to the right of the middle tells whether there is a run, and where it ends. All
middles of one depth, of all segments of many documents, are tested at once as arrays. The
agreement of two places is found by naming the stretches of 1, 2, 4, ... words: equal stretches
have equal names, and the longest agreement is a sum of powers of two.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_texts

LEAST = 12  # words of a run
_SCHEMA = "n_words long, starts array<long>, lengths array<long>, periods array<long>, collapsed string"


def overlap(least: int = LEAST) -> int:
    """Least number of words that a run shares with its own copy one period later."""
    return min(max(least, 2 * q) - q for q in range(1, least + 1))


def repeated_grams(ids: np.ndarray, owner: np.ndarray, k: int) -> np.ndarray:
    """Whether each word stands in a k-gram that occurs again in its document. Grams are told apart by a hash, so a collision
    only lets a word survive."""
    out = np.zeros(len(ids), bool)
    n = len(ids) - k + 1
    if n <= 1:
        return out
    grams = owner[:n].astype(np.uint64)
    for j in range(k):
        grams = (grams ^ ids[j : j + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        grams ^= grams >> np.uint64(29)
    whole = np.nonzero(owner[:n] == owner[k - 1 :])[0]
    grams = grams[whole]
    order = np.argsort(grams)
    same = grams[order[1:]] == grams[order[:-1]]
    again = np.zeros(len(order), bool)
    again[1:] |= same
    again[:-1] |= same
    first = whole[order[again]]
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + k, -1)
    return edge.cumsum()[:-1] > 0


class Agreement:
    """How far the words at two places agree, for many pairs of places at once."""

    def __init__(self, ids: np.ndarray, longest: int):
        self.names = [np.unique(ids, return_inverse=True)[1].astype(np.int32)]
        while 2 << len(self.names) - 1 <= longest:
            half = 1 << len(self.names) - 1
            last = self.names[-1]
            pairs = last[:-half].astype(np.int64) << 32 | last[half:]
            self.names.append(np.unique(pairs, return_inverse=True)[1].astype(np.int32))

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words from ``a`` and from ``b > a`` on that agree."""
        out = np.zeros(len(a), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            names = self.names[level]
            at_a, at_b = a + out, b + out
            fits = at_b < len(names)
            last = len(names) - 1
            out += (fits & (names[np.minimum(at_a, last)] == names[np.minimum(at_b, last)])).astype(np.int64) << level
        return out

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words before ``a`` and before ``b > a`` that agree."""
        out = np.zeros(len(a), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            names, size = self.names[level], 1 << level
            at_a, at_b = a - out - size, b - out - size
            out += ((at_a >= 0) & (names[np.maximum(at_a, 0)] == names[np.maximum(at_b, 0)])).astype(np.int64) << level
        return out


def main_lorentz(ids: np.ndarray, low: np.ndarray, high: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(start, length, period) of every run of the segments ``[low, high)`` of ``ids``, by start and period.

    The word before a segment and the one after it must differ from all others.
    """
    found = [np.zeros((0, 3), np.int64)]
    agreement = Agreement(ids, int((high - low).max(initial=1)))
    while len(low):
        wide = high - low >= least
        low, high = low[wide], high[wide]
        middle = (low + high) // 2
        for left in (True, False):
            room = middle - low if left else high - middle
            centre = np.repeat(middle, room)
            period = np.arange(len(centre)) - np.repeat(np.cumsum(room) - room, room) + 1
            # the word at the middle's own side agrees with the one a period away, else the run doesn't cross the middle
            a, b = (centre - period, centre) if left else (centre - 1, centre + period - 1)
            same = ids[a] == ids[b]
            centre, period = centre[same], period[same]
            a, b = (centre - period, centre) if left else (centre, centre + period)
            after, before = agreement.forward(a, b), agreement.backward(a, b)
            length = period + before + after
            runs = (length >= 2 * period) & (length >= least)
            found.append(np.stack([(a - before)[runs], length[runs], period[runs]], 1))
        low, high = np.concatenate([low, middle]), np.concatenate([middle, high])
    runs = np.concatenate(found)
    # a stretch found with several periods has the smallest of them
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def runs_of(texts: list[list], least: int = LEAST) -> list[np.ndarray]:
    """The runs of each of several lists of words, (start, length, period) by start and period."""
    numbers: dict = {}
    counts = np.array([len(words) for words in texts], np.int64)
    ids = np.array([numbers.setdefault(w, len(numbers)) for words in texts for w in words], np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    kept = repeated_grams(ids, owner, overlap(least))
    # segments of surviving words, each followed by a word of its own
    begins = np.ones(len(ids), bool)
    begins[1:] = ~kept[:-1] | (owner[1:] != owner[:-1])
    place = np.nonzero(kept)[0]
    out = [np.zeros((0, 3), np.int64)] * len(texts)
    if not len(place):
        return out
    segment = np.cumsum(begins[place]) - 1
    first = np.nonzero(begins[place])[0]
    n = np.diff(np.append(first, len(place)))
    low = first + np.arange(1, len(first) + 1)
    line = np.arange(-1, -2 - len(place) - len(first), -1)
    line[np.arange(len(place)) + segment + 1] = ids[place]
    runs = main_lorentz(line, low, low + n, least)
    nth = np.searchsorted(low, runs[:, 0], "right") - 1
    start = place[first[nth]] + runs[:, 0] - low[nth]
    of = owner[start]
    runs[:, 0] = start - (np.cumsum(counts) - counts)[of]
    ends = np.searchsorted(of, np.arange(len(texts) + 1))
    for k in np.unique(of):
        out[k] = runs[ends[k] : ends[k + 1]]
    return out


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Whether each of ``n`` words stays: all but those of a run after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return edge.cumsum()[:-1] == 0


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, starts, lengths, periods, collapsed) of every row; words are separated by ASCII white space.

    The three lists have an entry a run, by start and period. ``collapsed`` has the words that
    stay when each run is cut to its first period, joined by one space. Null and empty texts have
    no words and collapse to the empty string. Repeated rows and rows with a null id are like any other; an empty table
    gives an empty result; other columns are ignored. A text is handled whole, by one task.
    """

    def score(texts):
        words = [t.encode().split() for t in texts]
        found = runs_of(words, least)
        collapsed = []
        for own, runs in zip(words, found):
            if len(runs):
                own = [own[k] for k in np.nonzero(kept_words(len(own), runs))[0].tolist()]
            collapsed.append(b" ".join(own).decode())
        lists = [pa.array([r[:, c].tolist() for r in found], pa.list_(pa.int64())) for c in range(3)]
        return [pa.array([len(w) for w in words], pa.int64()), *lists, pa.array(collapsed, pa.string())]

    return map_texts(docs, id_col, text_col, score, _SCHEMA, 1_000_000)


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of the result of ``find_runs``;
    start, length and period are those of the longest run, of equal ones the first by start and period, and null without a run."""
    all_runs = F.arrays_zip("starts", "lengths", "periods")
    best = F.array_min(F.transform(all_runs, lambda r: F.struct((-r["lengths"]).alias("l"), r["starts"].alias("s"), r["periods"].alias("p"))))
    lines = F.transform(all_runs, lambda r: F.concat(r["starts"].cast("string"), F.lit(","), r["lengths"].cast("string"), F.lit(","), r["periods"].cast("string"), F.lit("\n")))
    best_of = found.withColumn("best", best)
    return best_of.select(
        "doc_id", F.size("starts").cast("long").alias("n_runs"), F.col("best.s").alias("start"), (-F.col("best.l")).alias("length"), F.col("best.p").alias("period"),
        F.floor(-1000 * F.col("best.l") / F.col("best.p")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): with h = crc32(id), a tenth of the texts (h % 10 = 0) repeat a stretch of their words from word a on.

    Word i >= a becomes word ``a + (i - a) % p``, with ``g = h div 10``, ``a = g % n``, ``p = 1 + (n - a) div (3 + g % 8)``.
    Rows with a null id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), h.alias("h"))
    chosen = F.coalesce(F.col("h") % 10 == 0, F.lit(False))
    words = rows.where(chosen).withColumn("w", F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    numbers = words.selectExpr("*", "cast(size(w) AS long) AS n", "h div 10 AS g")
    numbers = numbers.selectExpr("*", "CASE WHEN n > 0 THEN g % n END AS a").selectExpr("*", "1 + (n - a) div (3 + g % 8) AS p")
    # one list of places, then one lookup a place: no list is made anew for each word
    moved = numbers.selectExpr("doc_id", "text", "n", "transform(w, (x, i) -> CASE WHEN i < a THEN x ELSE w[int(a + (i - a) % p)] END) AS w")
    texts = moved.selectExpr("doc_id", "CASE WHEN n > 0 THEN array_join(w, ' ') ELSE text END AS text")
    return rows.where(~chosen).select("doc_id", "text").unionByName(texts)
