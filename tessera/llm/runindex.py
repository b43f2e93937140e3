"""Long repeated strings of a corpus, found with run-length compressed suffix indexes.

A byte is repeated if a string of ``length`` bytes that covers it also starts anywhere else in the corpus.

Dealing out. Every window of ``length`` bytes is known by its minimiser, the ``GRAM``-byte gram of
smallest hash in it; equal windows have equal minimisers. Neighbouring windows with one minimiser
form a segment, so each window of a text lies in exactly one segment, and windows that are equal meet
under one key, the minimiser's hash. What is counted and joined for all of the corpus is a row of
numbers a segment. Keys met once are dropped. A segment whose whole string occurs again is repeated,
without a look at its text. Only the rest, segments that share a minimiser but differ, as they do at
the ends of a repeated passage, is compared as text, in batches of keys.

Index. ``RunIndex`` sorts the suffixes of a batch's segments and keeps the Burrows-Wheeler transform as its runs, with the
suffixes at both ends of each run as samples. The agreement of a suffix with its neighbour
in the order is compared as text at these samples alone: inside a run, the byte before both is the same,
so the suffixes that start one byte earlier are neighbours too, and agree in one byte more. Streaming over the
text from sample to sample thus gives the matching statistics, the longest match that starts at each byte. The more the text
repeats, the fewer runs it has.

A key with more than ``MOST_SEGMENTS`` different segments, such as the edge of a passage that a third of all
documents have, would be too much text for one batch. Its windows are told apart by two 64-bit hashes instead,
which Spark counts like any other rows. The result is the same.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialize, portions

LENGTH = 200
GRAM = 64
MOST_SEGMENTS = 4096
BATCH = 1_000_000  # bytes of segments that an index is built of, and one key's more at most
CHUNK = 1 << 21  # windows looked at together
_MIX = tuple(np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on, as a number."""
    return np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))


def gram_hashes(data: np.ndarray, size: int, mix: int = 0) -> np.ndarray:
    """A hash of the ``size`` bytes (8 or more) from each byte on."""
    width, now = 8, _words(data) * _MIX[mix]
    now ^= now >> np.uint64(31)
    while width < size:
        step = min(width, size - width)
        now = now[:-step] * _MIX[mix + 1] + now[step:]
        now ^= now >> np.uint64(29)
        width += step
    return now


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        values = np.minimum(values[:-step], values[step:])
        reach += step
    return values


def segments(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(first byte, bytes, minimiser's hash) of each segment of the texts that end at ``ends`` in ``data``."""
    sizes = np.diff(ends, prepend=0)
    end_of = np.repeat(ends, sizes)
    out = []
    for chunk in range(0, max(0, len(data) - length + 1), CHUNK):
        part = data[chunk : chunk + CHUNK + length - 1]
        hashes = gram_hashes(part, gram)
        place = np.uint64((1 << 22) - 1)
        # the upper bits of the hash, then the place: of equal ones the leftmost
        least = sliding_minimum(hashes & ~place | np.arange(len(hashes), dtype=np.uint64), length - gram + 1)
        window = np.nonzero(end_of[chunk : chunk + len(least)] >= np.arange(chunk + length, chunk + length + len(least)))[0]
        if not len(window):
            continue
        at = (least[window] & place).astype(np.int64)
        new = np.ones(len(window), bool)
        new[1:] = (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1)
        first = np.nonzero(new)[0]
        n = np.diff(np.append(first, len(window)))
        out.append((window[first] + chunk, n + length - 1, hashes[at[first]].view(np.int64)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*out))


class RunIndex:
    """The run-length compressed Burrows-Wheeler transform of segments, with samples at the runs' ends.

    Each segment ends with a mark below all bytes; equal suffixes of two segments are in the order of the
    segments. ``runs`` holds the first row of each run, ``heads`` and ``tails`` the suffixes (as places in
    ``line``, where each segment is followed by its mark) at the first and the last row of each run.
    """

    def __init__(self, pieces: np.ndarray, ends: np.ndarray):
        sizes = np.diff(ends, prepend=0)
        of = np.repeat(np.arange(len(ends)), sizes)
        n = len(pieces) + len(ends)
        self.first = ends - sizes + np.arange(len(ends))  # of each segment, in the line
        self.place = np.arange(len(pieces)) + of  # of each byte, in the line
        self.line = np.zeros(n + 16, np.uint8)
        self.line[self.place] = pieces
        self.left = np.zeros(n + 16, np.int32)  # bytes from here to the segment's end
        self.left[self.place] = ends[of] - np.arange(len(pieces))
        order = self._suffixes(int(sizes.max(initial=1)))
        before = self.line[order - 1].astype(np.int16)
        before[np.isin(order, self.first)] = -1
        starts = np.ones(len(order), bool)
        starts[1:] = (before[1:] != before[:-1]) | (before[1:] < 0)
        self.runs = np.nonzero(starts)[0]
        last = np.append(self.runs[1:], len(order)) - 1
        self.heads, self.tails = order[self.runs], order[last]
        # agreement with the suffix before a run's first one, and after its last one
        above, below = order[np.maximum(self.runs - 1, 0)], order[np.minimum(last + 1, len(order) - 1)]
        self.head_agrees = np.where(self.runs > 0, self._agree(self.heads, above), 0)
        self.tail_agrees = np.where(last < len(order) - 1, self._agree(self.tails, below), 0)

    def _suffixes(self, longest: int) -> np.ndarray:
        """The places of all bytes in the order of their suffixes, by doubling the sorted depth of those still tied."""
        places, left = self.place, self.left
        symbols = self.line.astype(np.uint64)
        symbols[places] += np.uint64(1)
        key = np.zeros(len(places), np.uint64)
        for k in range(7):
            key = key << np.uint64(9) | np.where(left[places] > k, symbols[places + k], np.uint64(0))
        sort = np.argsort(key)
        order, key = places[sort], key[sort]
        rank = np.zeros(len(self.line), np.int64)  # 1 + the first row of those that agree so far; 0 for a mark
        rows = np.arange(len(order))
        depth = 7
        while True:
            new = np.ones(len(rows), bool)
            new[1:] = key[1:] != key[:-1]
            rank[order[rows]] = np.maximum.accumulate(np.where(new, rows + 1, 0))
            tied = ~(new & np.append(new[1:], True))
            rows = rows[tied]
            if not len(rows):
                return order
            now = order[rows]
            if depth < longest:
                next_rank = np.where(left[now] > depth, rank[np.minimum(now + depth, len(rank) - 1)], 0)
            else:
                next_rank = now
            key = rank[now] << 32 | next_rank
            sort = np.argsort(key)
            order[rows], key = now[sort], key[sort]
            depth *= 2

    def _agree(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes in which pairs of suffixes agree, eight at a time."""
        words = _words(self.line)
        most = np.minimum(self.left[a], self.left[b]).astype(np.int64)
        out = np.zeros(len(a), np.int64)
        active = np.arange(len(a))
        while len(active):
            differ = words[a[active] + out[active]] ^ words[b[active] + out[active]]
            whole = (differ == 0) & (out[active] + 8 < most[active])
            rest = active[~whole]
            low = differ[~whole]
            equal = np.zeros(len(rest), np.int64)
            for k in range(8):
                equal += (equal == k) & (low >> np.uint64(8 * k) & np.uint64(255) == 0)
            out[rest] = np.minimum(out[rest] + equal, most[rest])
            active = active[whole]
            out[active] += 8
        return out

    def matching_statistics(self) -> np.ndarray:
        """For each byte of the segments, the length of the longest string that starts there and at another byte too."""
        best = np.zeros(len(self.place), np.int64)
        for samples, agrees in ((self.heads, self.head_agrees), (self.tails, self.tail_agrees)):
            value = np.zeros(len(self.line), np.int64)
            known = np.zeros(len(self.line), np.int64)
            value[samples], known[samples] = agrees, samples
            at = np.maximum.accumulate(known)[self.place]
            np.maximum(best, value[at] - (self.place - at), out=best)
        return best


def spans_of(flags: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the bytes covered by the windows whose first bytes are flagged, for each run of flags."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0] - 1 + length


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs of covered bytes; spans that touch are one."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    first = np.nonzero(new)[0]
    return starts[first], ends[np.append(first[1:], len(starts)) - 1] if len(starts) else ends


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and where each value ends in them."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return data, at[1:] - at[0]


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _named(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, a, b, text binary): a text is known by two 64-bit hashes."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return texts.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"), text.cast("binary").alias("text"))


def _segment_rows(texts: DataFrame, length: int, gram: int, whole: bool) -> DataFrame:
    """A row a segment, some more than once: its key and a hash of its place; or, ``whole``, its key, a hash of its string, its text, first byte and size."""

    def run(batches):
        seen: set = set()
        for batch in batches:
            for part in portions(batch, 2, 1_500_000):
                part = _unseen(part, seen)
                data, ends = _flat(part.column(2))
                first, size, key = segments(data, ends, length, gram)
                text = np.searchsorted(ends, first, "right")
                start = first - (ends - np.diff(ends, prepend=0))[text]
                a, b = _numbers(part.column(0))[text], _numbers(part.column(1))[text]
                if whole:
                    raw = memoryview(data)
                    strings = [xxhash.xxh3_64_intdigest(raw[f : f + s]) for f, s in zip(first.tolist(), size.tolist())]
                    columns = [key, np.array(strings, np.uint64).view(np.int64), a, b, start.astype(np.int32), size.astype(np.int32)]
                else:
                    place = (a.view(np.uint64) * _MIX[0] ^ b.view(np.uint64)) * _MIX[1] + start.astype(np.uint64)
                    columns = [key, ((place ^ place >> np.uint64(31)) * _MIX[2]).view(np.int64)]
                yield pa.record_batch([pa.array(c) for c in columns], names=names)

    schema = "key long, string long, a long, b long, start int, size int" if whole else "key long, place long"
    names = [c.split()[0] for c in schema.split(", ")]
    return texts.select("a", "b", "text").mapInArrow(run, schema)


def _unseen(part: pa.RecordBatch, seen: set) -> pa.RecordBatch:
    """The rows whose text a task meets first; it forgets them now and then, which only repeats some."""
    if len(seen) > 200_000:
        seen.clear()
    kept = []
    for k, pair in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist())):
        if pair not in seen:
            seen.add(pair)
            kept.append(k)
    return part if len(kept) == len(part) else part.take(pa.array(kept, pa.int64()))


def _once_a_task(texts: DataFrame) -> DataFrame:
    """The texts without most of the copies."""

    def run(batches):
        seen: set = set()
        for batch in batches:
            yield _unseen(batch, seen)

    return texts.select("a", "b", "text").mapInArrow(run, "a long, b long, text binary")


def _indexed(pieces: DataFrame, length: int) -> DataFrame:
    """(a, b, lo, hi): the repeated spans of the segments ``pieces(key, a, b, start, own, piece)`` that are ``own``."""

    def found(table: pa.Table):
        table = table.combine_chunks().to_batches()[0]
        a, b, start = (_numbers(table.column(n)) for n in ("a", "b", "start"))
        order = np.lexsort((start, b, a))
        same = (a[order[1:]] == a[order[:-1]]) & (b[order[1:]] == b[order[:-1]]) & (start[order[1:]] == start[order[:-1]])
        table = table.take(pa.array(np.sort(np.delete(order, np.nonzero(same)[0] + 1))))
        a, b, start, own = (_numbers(table.column(n)) for n in ("a", "b", "start", "own"))
        data, ends = _flat(table.column("piece"))
        matches = RunIndex(data, ends).matching_statistics() >= length
        lo, hi = spans_of(matches, length)  # a window never passes its segment's end, so neither do runs of them
        of = np.searchsorted(ends, lo, "right")
        lo, hi, of = lo[own[of]], hi[own[of]], of[own[of]]
        shift = start[of] - (ends - np.diff(ends, prepend=0))[of]
        return pa.record_batch([pa.array(c) for c in (a[of], b[of], (lo + shift).astype(np.int64), (hi + shift).astype(np.int64))], names=["a", "b", "lo", "hi"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in portions(batch, 5, BATCH // 4):
                held.append(part)
                size += part.nbytes
                if size < BATCH:
                    continue
                table = pa.Table.from_batches(held)
                keys = table.column("key").to_numpy()
                upto = int(np.searchsorted(keys, keys[-1]))  # rows are sorted by key; the last key may go on
                if upto:
                    yield found(table.slice(0, upto))
                    held, size = table.slice(upto).to_batches(), table.slice(upto).nbytes
        if held:
            yield found(pa.Table.from_batches(held))

    dealt = pieces.select("key", "a", "b", "start", "own", "piece").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "a long, b long, lo long, hi long")


def _by_window(pieces: DataFrame, length: int) -> DataFrame:
    """(a, b, lo, hi) as ``_indexed``, a row a window."""

    def run(batches):
        for batch in batches:
            for part in portions(batch, 3, 200_000):
                data, ends = _flat(part.column(3))
                if len(data) < length:
                    continue
                hashes = [gram_hashes(data, length, mix).view(np.int64) for mix in (0, 2)]
                at = np.arange(len(hashes[0]))
                of = np.searchsorted(ends, at, "right")
                fits = at + length <= ends[of]
                at, of = at[fits], of[fits]
                lo = _numbers(part.column(2))[of] + at - (ends - np.diff(ends, prepend=0))[of]
                columns = [hashes[0][fits], hashes[1][fits], _numbers(part.column(0))[of], _numbers(part.column(1))[of], lo.astype(np.int64), _numbers(part.column(4))[of]]
                yield pa.record_batch([pa.array(c) for c in columns], names=["h1", "h2", "a", "b", "lo", "own"])

    rows = pieces.select("a", "b", "start", "piece", "own").mapInArrow(run, "h1 long, h2 long, a long, b long, lo long, own boolean")
    place = F.xxhash64("a", "b", "lo")
    again = rows.groupBy("h1", "h2").agg(F.min(place).alias("least"), F.max(place).alias("most")).where("least < most")
    met = rows.where("own").join(again.select("h1", "h2"), ["h1", "h2"], "left_semi")
    return met.select("a", "b", "lo", (F.col("lo") + length).alias("hi"))


def _results(fetched: DataFrame) -> DataFrame:
    """(a, b, starts, ends, kept_sha256) of texts with the spans that cover parts of them."""

    def run(batches):
        for batch in batches:
            rows = []
            for a, b, text, los, his in zip(*(batch.column(k) for k in range(5))):
                lo, hi = merged(np.array(los.as_py() or [], np.int64), np.array(his.as_py() or [], np.int64))
                text, digest, at = memoryview(text.as_buffer()), hashlib.sha256(), 0
                for start, end in zip(lo.tolist(), hi.tolist()):
                    digest.update(text[at:start])
                    at = end
                digest.update(text[at:])
                rows.append((a.as_py(), b.as_py(), lo.tolist(), hi.tolist(), digest.hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string()]
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["a", "b", "starts", "ends", "kept_sha256"])

    return fetched.mapInArrow(run, "a long, b long, starts array<long>, ends array<long>, kept_sha256 string")


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, most_segments: int = MOST_SEGMENTS
) -> DataFrame:
    """(doc_id, n_bytes, starts, ends, kept_sha256) of every row: the maximal spans of UTF-8 bytes that a repeated string of
    ``length`` bytes (more than ``gram``) covers, and the SHA-256 of the other bytes.

    Null texts are empty. Repeated rows and rows with a null id are texts like any other, so the whole of
    a repeated row is repeated if it is long enough. An empty table gives an empty result. Columns
    besides the two named are ignored.
    """
    texts = _named(docs, id_col, text_col)
    rows = texts.select("doc_id", "a", "b", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole_sha256"))
    long = texts.where(F.octet_length("text") >= length)
    # texts are read and cut anew for each use: that costs less disk than keeping the segments of all
    met = _segment_rows(long, length, gram, False).groupBy("key").agg(F.min("place").alias("least"), F.max("place").alias("most"))
    # written tables on both sides of the joins by key: Spark can then split a key that very many segments have
    shared = materialize(met.where("least < most").select("key"), "repeats-shared")
    near = materialize(_segment_rows(long, length, gram, True).join(shared, "key", "left_semi"), "repeats-near")
    discard(shared)
    place = F.xxhash64("a", "b", "start")
    strings = near.groupBy("key", "string").agg(F.min(place).alias("least"), (F.min(place) < F.max(place)).alias("again"))
    strings = materialize(strings, "repeats-strings")
    keys = strings.groupBy("key").agg(F.count("key").alias("n"), F.sum(F.when(F.col("again"), 0).otherwise(1)).alias("alone"))
    keys = materialize(keys.select("key", (F.col("alone") > 0).alias("compare"), (F.col("n") > most_segments).alias("many")), "repeats-keys")
    judged = materialize(strings.join(keys, "key").where("again OR compare"), "repeats-judged")
    discard(strings, keys)
    # a segment that occurs again is covered; one of its places stands for it where others have to be compared with it
    compare = F.col("compare") & (~F.col("again") | (place == F.col("least")))
    item = F.struct("start", "size", "key", "again", compare.alias("compare"), "many")
    lists = near.join(judged, ["key", "string"]).groupBy("a", "b").agg(F.collect_set(item).alias("items"))
    lists = materialize(lists, "repeats-lists")
    discard(near, judged)
    fetched = materialize(_once_a_task(long).join(lists, ["a", "b"]), "repeats-texts")
    discard(lists)
    pieces = fetched.selectExpr(
        "a", "b",
        "inline(transform(filter(items, x -> x.compare), x -> struct(x.key AS key, x.start AS start, NOT x.again AS own, x.many AS many, substring(text, x.start + 1, x.size) AS piece)))",
    )
    spans = _indexed(pieces.where("NOT many"), length).unionByName(_by_window(pieces.where("many"), length))
    spans = materialize(spans, "repeats-spans")
    of_text = spans.groupBy("a", "b").agg(F.collect_set(F.struct("lo", "hi")).alias("found"))
    own = "filter(items, x -> x.again)"
    covered = fetched.join(of_text, ["a", "b"], "left").selectExpr(
        "a", "b", "text",
        f"concat(transform({own}, x -> cast(x.start AS long)), coalesce(found.lo, array())) AS los",
        f"concat(transform({own}, x -> cast(x.start AS long) + x.size), coalesce(found.hi, array())) AS his",
    )
    results = _results(covered).dropDuplicates(["a", "b"])
    copies = rows.groupBy("a", "b").agg(F.count("a").alias("copies")).where("copies > 1")
    results = materialize(results.join(copies, ["a", "b"], "full"), "repeats-results")
    discard(fetched, spans)
    joined = rows.join(results, ["a", "b"], "left")
    whole = F.col("copies").isNotNull() & (F.col("n_bytes") >= length)
    none = F.array().cast("array<long>")
    return joined.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.array(F.lit(0).cast("long"))).otherwise(F.coalesce("starts", none)).alias("starts"),
        F.when(whole, F.array("n_bytes")).otherwise(F.coalesce("ends", none)).alias("ends"),
        F.when(whole, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"),
    )
