"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. Text is
first normalised: lower case, ASCII letters and digits kept, other ASCII as single
spaces. A text is cut in overlapping windows, every window is compressed with either
dictionary, and the gap between the two lengths says which class it is nearer.

A dictionary has a base and a class part, each made by zstandard's own trainer. The base
is trained on windows of ordinary text and is the same in both, so that what all text
has in common cancels out. The class part is trained on the stretches of its class's
texts that are typical of it: six-byte segments that its texts hold often. A text of the class may hold a
stem many times with changing ends where others hold it once, so the texts that hold a segment once, twice, and so on are
counted each for itself, and a likelihood ratio test against the number of tests tried decides. Near copies among the
training texts count once, else a copied document would pass for what its class has in common. Both class parts are
padded to one length, so the dictionaries have one layout and offsets cost the same.

A document's features are its largest gap, the logarithms of the numbers of windows with gaps above a few limits,
and the logarithm of its number of windows, as more gaps come by chance in more windows. Logistic
regression weighs them (the weight of the largest gap is never negative), on gaps measured out of fold: each fifth
of the training documents is measured with dictionaries learned from the others.
Isotonic regression maps the weighted sum to the share of toxic documents, the score,
which mislabelled rows at either end don't flatten. ``THRESHOLD`` applies to the score.

Bounds of training: ``PER_CLASS`` labelled documents of each class, ``BASE_WINDOWS`` windows of the ordinary ones
for the base, and ``CLASS_BYTES`` of stretches, which the trainer fills with those it finds most often.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fit_logistic, held_out, labelled_sample, map_texts, text_column, trim

WINDOW, STRIDE = 64, 48  # bytes of normalised text
SEGMENT = 6
BASE_BYTES, CLASS_BYTES = 8_192, 7_936  # of a dictionary; together within the 16 kB window, so that all of it is searched
BASE_WINDOWS = 60_000  # windows of ordinary text, evenly spaced, that the base is trained on at most
PER_CLASS = 3000  # labelled documents of each class that training takes at most
FOLDS = 5
SLICES = 4  # of segments, counted one after another
TIMES = 4  # a segment's texts are counted by whether they hold it once, twice, and so on up to so often
LARGEST = 1  # largest gaps that are features
LIMITS = (1, 2, 3, 5)  # bytes of gap above which windows are counted
FEATURES = LARGEST + len(LIMITS) + 1
THRESHOLD = 0.7
_LETTERS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_SPACES = re.compile(b"  +")
_MIX = tuple(np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))


def normalise(text: str) -> bytes:
    return b" " + _SPACES.sub(b" ", text.lower().encode().translate(_LETTERS)).strip() + b" "


def spans_of(length: int) -> np.ndarray:
    """(windows, 2): first byte and length of each window of a text."""
    starts = np.arange(0, max(1, length - (WINDOW - STRIDE)), STRIDE)
    return np.stack([starts, np.minimum(WINDOW, length - starts)], 1)


def _packed(text: bytes) -> np.ndarray:
    """The segment that starts at each byte, as a number."""
    raw = np.frombuffer(text, np.uint8).astype(np.uint64)
    out = np.zeros(max(0, len(raw) - SEGMENT + 1), np.uint64)
    for k in range(SEGMENT):
        out = out << np.uint64(8) | raw[k : len(out) + k]
    return out


def common_segments(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
    """(segments that two texts or more hold, sorted, the numbers of these texts, number of all segments). Summed up a few
    hundred thousand at a time, and in slices of the segments, which bounds the memory that training takes."""
    segments, held_by, tried = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], 0
    for part in range(SLICES):
        total, counts, found, held = np.zeros(0, np.uint64), np.zeros(0, np.int32), [], 0
        for k, text in enumerate(texts):
            packed = _packed(text)
            found.append(np.unique(packed[packed * _MIX[0] >> np.uint64(62) == part]))
            held += len(found[-1])
            if held > 500_000 or k == len(texts) - 1:
                some, n = np.unique(np.concatenate(found), return_counts=True)
                total, back = np.unique(np.concatenate([total, some]), return_inverse=True)
                counts = np.bincount(back, np.concatenate([counts, n]), minlength=len(total)).astype(np.int32)
                found, held = [], 0
        segments.append(total[counts > 1])
        held_by.append(counts[counts > 1])
        tried += len(total)
    order = np.argsort(found := np.concatenate(segments))
    return found[order], np.concatenate(held_by)[order], tried


def count_segments(texts: list[bytes], segments: np.ndarray) -> np.ndarray:
    """(TIMES, segments): how many texts hold each of some sorted segments once, twice, and so on."""
    out = np.zeros((TIMES, len(segments)), np.int64)
    for text in texts if len(segments) else ():
        packed = _packed(text)
        at = np.minimum(np.searchsorted(segments, packed), len(segments) - 1)
        held, times = np.unique(at[segments[at] == packed], return_counts=True)
        for k in range(TIMES):
            out[k, held[times > k]] += 1
    return out


def without_copies(texts: list[bytes], length: int = 24) -> list[bytes]:
    """The texts that share none of their four minimum hashes of ``length``-byte runs with an earlier one."""
    seen: set = set()
    out = []
    for text in texts:
        raw = np.frombuffer(text, np.uint8).astype(np.uint64)
        n = min(length, len(raw))
        runs = np.zeros(len(raw) - n + 1, np.uint64)
        for k in range(n):
            runs = runs * np.uint64(0x100000001B3) ^ raw[k : len(runs) + k]
        keys = set()
        for mix in _MIX:
            hashes = runs * mix
            hashes ^= hashes >> np.uint64(32)
            keys.add((int(mix), int((hashes * mix).min())))
        if not keys & seen:
            out.append(text)
        seen |= keys
    return out


class Typical:
    """Which segments are typical of either class, toxic (0) and ordinary (1), in any choice of folds of their texts.

    A segment is typical if texts of the class hold it, or hold it repeatedly, at least eight times as frequently as those of the
    other beyond chance. The statistic passes where less than one segment of all that were tried is expected to by chance.
    Segments of so few texts that they can't pass are not counted.
    """

    def __init__(self, folds: list[list[list[bytes]]]):
        self.sizes = np.array([[len(f) for f in own] for own in folds], float)
        n, self.segments, self.limits, self.counts = self.sizes.sum(1), [], [], []
        for y, own in enumerate(folds):
            texts = [t for f in own for t in f]
            chance = np.log(1 + max(1.0, n[1 - y]) / max(1.0, n[y]))
            segments, held_by, tried = common_segments(texts)
            limit = np.log(max(2, tried * TIMES))
            segments = segments[held_by >= limit / chance]
            self.segments.append(segments)
            self.limits.append(2 * limit)
            self.counts.append([[count_segments(f, segments) for f in side] for side in folds])

    def of(self, y: int, folds: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(segments, greatest test statistic) of a class."""
        n, m = max(1.0, self.sizes[y, folds].sum()), max(1.0, self.sizes[1 - y, folds].sum())
        here, there = (np.sum([self.counts[y][side][f] for f in folds], 0) for side in (y, 1 - y))
        both = np.maximum(here + there, 1e-9) / (n + m)
        statistic = 2 * (here * np.log(np.maximum(here, 1e-9) / (n * both)) + there * np.log(np.maximum(there, 1e-9) / (m * both)))
        best = np.where((here / n >= 8 * (there + 0.5) / (m + 1)) & (statistic > self.limits[y]), statistic, 0.0).max(0)
        return self.segments[y][best > 0], best[best > 0]


def stretches(texts: list[bytes], segments: np.ndarray, statistic: np.ndarray) -> list[bytes]:
    """The distinct runs of each text that typical segments cover; of segments that
    overlap only those near the greatest statistic count, which leaves chance neighbours out."""
    out = []
    for text in texts if len(segments) else ():
        packed = _packed(text)
        if not len(packed):
            continue
        at = np.minimum(np.searchsorted(segments, packed), len(segments) - 1)
        own = np.where(segments[at] == packed, statistic[at], 0.0)
        most = np.lib.stride_tricks.sliding_window_view(np.pad(own, SEGMENT - 1), 2 * SEGMENT - 1).max(1)
        first = np.nonzero((own > 0) & (own >= 0.9 * most))[0]
        edge = np.zeros(len(text) + 1, np.int64)
        np.add.at(edge, first, 1)
        np.add.at(edge, first + SEGMENT, -1)
        covered = np.diff(np.concatenate([[0], (edge.cumsum()[:-1] > 0).astype(np.int8), [0]]))
        out += sorted({text[a:b] for a, b in zip(np.nonzero(covered == 1)[0], np.nonzero(covered == -1)[0])})
    return out


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary of the samples; of too few for the trainer, the distinct samples themselves."""
    samples = [s.ljust(8) for s in samples]
    try:
        return zstandard.train_dictionary(size, samples, k=16, d=6, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def train_dictionaries(texts: tuple[list[bytes], list[bytes]], typical: list[tuple[np.ndarray, np.ndarray]]) -> tuple[bytes, bytes]:
    """The toxic and the ordinary dictionary of (toxic, ordinary) texts without near copies, given the typical segments of either."""
    ordinary = texts[1]
    windows = sum(len(spans_of(len(t))) for t in ordinary)
    every, base, met = -(-windows // BASE_WINDOWS), [], 0
    for text in ordinary:
        spans = spans_of(len(text))
        base += [text[a : a + n] for a, n in spans[-met % every :: every].tolist()]
        met += len(spans)
    found = [stretches(own, *segments) for own, segments in zip(texts, typical)]
    parts = [train_dictionary(f, CLASS_BYTES) if f else b"" for f in found]
    shared = train_dictionary(base, BASE_BYTES) if base else b""
    size = max(map(len, parts))
    return shared + parts[0].rjust(size, b"\0"), shared + parts[1].rjust(size, b"\0")


@dataclass(frozen=True)
class ToxicityModel:
    dictionaries: tuple[bytes, bytes]  # toxic, ordinary
    weights: tuple[float, ...]  # of the features
    limits: tuple[float, ...]  # weighted sums at which the share steps up
    shares: tuple[float, ...]  # of toxic documents from each limit on

    def compressors(self) -> list:
        made = []
        for content in self.dictionaries:
            # a greedy search of the whole dictionary for six bytes or more: what is not in it doesn't change the length
            how = zstandard.ZstdCompressionParameters(
                window_log=14, hash_log=15, chain_log=14, search_log=9, min_match=SEGMENT, target_length=32,
                strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False,
            )
            if len(content) < 8:
                made.append(zstandard.ZstdCompressor(compression_params=how))
                continue
            trained = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            trained.precompute_compress(compression_params=how)
            made.append(zstandard.ZstdCompressor(compression_params=how, dict_data=trained))
        return made

    def features(self, texts: list[bytes], compressors=None, at_once: int = 20_000) -> np.ndarray:
        """(n, FEATURES): the largest gap of each text, or zero, the logarithms of one and its windows above each limit, and log(windows)."""
        if not texts:
            return np.zeros((0, FEATURES))
        compressors = compressors or self.compressors()
        spans = [spans_of(len(t)) for t in texts]
        counts = np.array([len(s) for s in spans])
        base = np.cumsum([0] + [len(t) for t in texts[:-1]])
        spans = np.concatenate([s + [b, 0] for s, b in zip(spans, base.tolist())]).astype("<u8")
        content = b"".join(texts)
        gaps = np.zeros(len(spans), np.int32)
        for first in range(0, len(spans), at_once):
            some = spans[first : first + at_once]
            low, high = int(some[0, 0]), int(some[-1].sum())
            windows = zstandard.BufferWithSegments(content[low:high], (some - np.array([low, 0], "<u8")).tobytes())
            for sign, c in zip((-1, 1), compressors):
                out = c.multi_compress_to_buffer(windows, threads=1)
                gaps[first : first + len(some)] += sign * np.fromiter((len(out[i]) for i in range(len(out))), np.int32, len(out))
        starts = np.cumsum(counts) - counts
        largest = np.maximum(np.maximum.reduceat(gaps, starts), 0)
        above = [np.log1p(np.add.reduceat((gaps >= limit).astype(np.int64), starts)) for limit in LIMITS]
        return np.stack([largest, *above, np.log(counts)], 1).astype(float)

    def scores(self, features: np.ndarray) -> np.ndarray:
        at = features @ np.array(self.weights)
        share = np.array(self.shares)[np.maximum(np.searchsorted(self.limits, at, "right") - 1, 0)]
        # within a step the sum still orders documents
        return share + 1e-6 * ((1 / (1 + np.exp(-np.clip(at, -50, 50)))) - share)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """(limits, shares): the non-decreasing steps nearest to ``y`` over ``x``, by pooling adjacent violators."""
    values, back = np.unique(x, return_inverse=True)
    weight = np.bincount(back).astype(float)
    blocks: list = []
    for v, mean, w in zip(values.tolist(), (np.bincount(back, y) / weight).tolist(), weight.tolist()):
        blocks.append((v, mean, w))
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            (low, a, m), (_, b, n) = blocks[-2], blocks[-1]
            blocks[-2:] = [(low, (a * m + b * n) / (m + n), m + n)]
    return tuple(b[0] for b in blocks), tuple(b[1] for b in blocks)


def fit(rows: list[tuple[int, int, str]]) -> ToxicityModel:
    """A model of (id, toxic 0 or 1, text) rows. Without rows of both classes it
    scores every text by the share of toxic rows, or zero without any row."""
    texts = [normalise(t) for _, _, t in rows]
    labels = np.array([y for _, y, _ in rows], float)
    none = (0.0,) * FEATURES
    if len(set(labels)) < 2:
        return ToxicityModel((b"", b""), none, (0.0,), (float(labels[0]) if len(rows) else 0.0,))
    fold_of = lambda t: zlib.crc32(t) % FOLDS  # noqa: E731  (copies stay together)
    alone = [without_copies([t for t, l in zip(texts, labels) if l == y]) for y in (1, 0)]
    parts = [[[t for t in own if fold_of(t) == f] for f in range(FOLDS)] for own in alone]
    typical = Typical(parts)

    def learned(left_out: int) -> tuple[bytes, bytes]:
        used = [f for f in range(FOLDS) if f != left_out]
        return train_dictionaries(tuple([t for f in used for t in own[f]] for own in parts), [typical.of(y, used) for y in (0, 1)])

    x, fold = np.zeros((len(texts), FEATURES)), np.array([fold_of(t) for t in texts])
    for f in range(FOLDS):
        at = np.nonzero(fold == f)[0]
        x[at] = ToxicityModel(learned(f), none, (0.0,), (0.0,)).features([texts[k] for k in at])
    used = np.arange(FEATURES)
    while True:
        found = fit_logistic(x[:, used], labels, l2=0.1)[:-1]
        negative = (found < 0) & (used < LARGEST)
        if not negative.any():
            break
        used = used[~negative]
    weights = np.zeros(FEATURES)
    weights[used] = found
    limits, shares = isotonic(x @ weights, labels)
    return ToxicityModel(learned(-1), tuple(weights.tolist()), limits, shares)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> ToxicityModel:
    """Fit on at most ``per_class`` labelled documents of each class, none of them held out."""
    model = fit(labelled_sample(docs, labels, "toxic", per_class))
    trim()  # the texts and counts of training would stay with the driver
    return model


def _scorer(model: ToxicityModel):
    """Scores of a list of texts; each worker makes its compressors once."""
    state: list = []

    def score(texts):
        if not state:
            state.append(model.compressors())
        return model.scores(model.features([normalise(t) for t in texts], state[0]))

    return score


def score_documents(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for every row of ``docs``, over whole texts.

    Null and empty texts score like a text without any gap. Repeated rows and rows
    with a null id are scored like any other; an empty table gives an empty
    result; other columns are ignored.
    """
    scores = _scorer(model)

    def score(texts):
        s = scores(texts)
        return [pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))]

    return map_texts(docs, id_col, text_col, score, "score double, predicted int", 300_000)


def predicted(model: ToxicityModel):
    """A column function: 1 for texts whose score reaches the threshold, else 0; null texts count as empty."""
    scores = _scorer(model)
    return text_column(lambda texts: (scores(texts) >= THRESHOLD).astype(np.int32), "int")


def op2_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_documents(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
