"""Packing by lexical retrieval.

Documents become token ids and an end id. They are ordered by their rarest tokens,
so that related texts lie together, and dealt out by ranges of that order with about
as many tokens each; every task cuts its range in shards of bounded size and builds a
BM25 index of each, with token ids as terms. The statistics (document frequencies, mean length) are those of
all documents; the vocabulary bounds their size.

A window starts with a seed document. The index returns the shard's unused
documents by their BM25 score for the seed, and they fill the window greedily; the
one that passes its end is cut, and the rest becomes the next seed. A window left
open at a shard's end is filled from the next shard. At the end of a task's range
the open window is split in pieces of power-of-two lengths, which need no padding.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.common import give_back, materialize, portions

WINDOW = 2048
END_ID = 1
SHARD_TOKENS = 500_000
TASK_TOKENS = 4_000_000
K1, B = 1.2, 0.75
TABLE = 1 << 21  # slots for words of up to 16 bytes
WORDS_KEPT = 800_000  # words that a worker keeps at most, beside those of one portion
# The pattern that cuts words between letters, single digits and other characters, but keeps an apostrophe's endings together.
CLASSES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_KIND = np.array([0 if c in b" \t\n\v\f\r" else 5 if c >= 128 else 1 if chr(c).isalpha() else 2 if chr(c).isdigit() else 4 if c == 39 else 3 for c in range(256)], np.uint8)
# Where a word starts (1) or ends (2) between two bytes, by white space, or by classes too: 6 times the kind before and the kind after.
_BY_SPACE = np.array([(a == 0 and b > 0) + 2 * (a > 0 and b == 0) for a in range(6) for b in range(6)], np.uint8)
_BY_CLASS = _BY_SPACE | np.array([3 * ((a, b) in {(1, 2), (1, 3), (1, 4), (2, 1), (2, 2), (2, 3), (2, 4), (3, 1), (3, 2)}) for a in range(6) for b in range(6)], np.uint8)
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_MIX = tuple(np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


class WordEncoder:
    """Ids of a word-level BPE file of the tokenizers library, with a table of words.

    White space is dropped, so a text's ids are those of its words, or of the parts that the file's own pattern cuts them in,
    and words met before are looked up as arrays. A word of up to 16 bytes is known by its length and its first and last eight bytes,
    a longer one by itself. The library encodes all new words of a portion in one call. Texts with a special
    token's string are encoded whole.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = file.read()
        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(content)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = [t for t in special if t]
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        self.bounds = _BY_CLASS if steps[0].get("pattern", {}).get("Regex") == CLASSES else _BY_SPACE
        self.lowers = '"Lowercase"' in json.dumps(spec["normalizer"])
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = "<u2" if self.size <= 1 << 16 else "<u4"
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros((3, TABLE), np.uint64)  # length, first and last eight bytes of the word in each slot
        self.word_of = np.full(TABLE, -1, np.int32)
        self.long: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, self.kind)  # of all words, one after another
        self.ends, self.words = np.zeros(1 << 14, np.int64), 0

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, words: list[bytes]) -> np.ndarray:
        """Encode words and give them numbers."""
        texts = [w.decode() for w in words]
        found = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        ids = np.array(found.ids, self.kind)
        upto = np.searchsorted([a for a, _ in found.offsets], np.cumsum([len(t) + 1 for t in texts]))
        first = int(self.ends[self.words - 1]) if self.words else 0
        while first + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.words + len(words) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[first : first + len(ids)] = ids
        self.ends[self.words : self.words + len(words)] = first + upto
        self.words += len(words)
        return np.arange(self.words - len(words), self.words)

    def _numbers(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The number of each word; ``data`` goes on for 16 bytes after the last."""
        raw = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        short = sizes <= 16
        mask = _MASKS[np.minimum(sizes, 8)]
        keys = np.stack([sizes.astype(np.uint64), raw[starts] & mask, raw[starts + np.maximum(sizes - 8, 0)] & mask])
        slot = ((keys[0] * _MIX[0] ^ keys[1]) * _MIX[1] ^ keys[2]) * _MIX[2]
        slot = (slot >> np.uint64(64 - TABLE.bit_length() + 1)).astype(np.int64)
        out = np.full(len(starts), -1, np.int64)
        rest, fresh = np.nonzero(short)[0], []
        while len(rest):
            at = slot[rest]
            number = self.word_of[at]
            same = (number >= 0) & (self.keys[:, at] == keys[:, rest]).all(0)
            out[rest[same]] = number[same]
            fresh.append(rest[number < 0])  # an empty slot: a new word
            rest = rest[(number >= 0) & ~same]
            slot[rest] = (slot[rest] + 1) & (TABLE - 1)
        fresh = np.sort(np.concatenate(fresh)) if fresh else np.zeros(0, np.int64)
        if len(fresh):
            order = np.lexsort(keys[:, fresh])
            new = np.ones(len(order), bool)
            new[1:] = (keys[:, fresh[order[1:]]] != keys[:, fresh[order[:-1]]]).any(0)
            firsts = fresh[order[new]]
            known = self._learn([data[starts[k] : starts[k] + sizes[k]].tobytes() for k in firsts.tolist()])
            out[firsts] = known
            out[fresh[order]] = out[firsts][np.cumsum(new) - 1]
            while len(known):  # each into the first free slot from its own on; of two that want one the last comes first
                at = slot[firsts]
                free = self.word_of[at] < 0
                self.word_of[at[free]] = known[free]
                placed = self.word_of[at] == known
                self.keys[:, at[placed]] = keys[:, firsts[placed]]
                firsts, known = firsts[~placed], known[~placed]
                slot[firsts] = (slot[firsts] + 1) & (TABLE - 1)
        longer = np.nonzero(~short)[0].tolist()
        words = [data[starts[k] : starts[k] + sizes[k]].tobytes() for k in longer]
        unknown = [w for w in dict.fromkeys(words) if w not in self.long]
        if unknown:
            self.long.update(zip(unknown, self._learn(unknown).tolist()))
        out[longer] = [self.long[w] for w in words]
        return out

    def encode_all(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after another, where each text's end); ``end`` follows each text."""
        if self.words > WORDS_KEPT:
            self._forget()
        whole = {k: self._ids(t) for k, t in enumerate(texts) if any(map(t.__contains__, self.special))}
        raw = [b"" if k in whole else t.encode() for k, t in enumerate(texts)]
        data = np.frombuffer(b" ".join(raw) + bytes(16), np.uint8)
        if self.lowers:  # as the library will, for all but non-ASCII letters
            data = _LOWER[data]
        text_ends = np.cumsum([len(r) + 1 for r in raw])
        kind = np.zeros(len(data) - 14, np.uint8)
        kind[1:-1] = _KIND[data[:-16]]
        edge = self.bounds[kind[:-1] * 6 + kind[1:]]
        starts, stops = np.nonzero(edge & 1)[0], np.nonzero(edge & 2)[0]
        numbers = self._numbers(data, starts, stops - starts)
        begin = np.where(numbers > 0, self.ends[numbers - 1], 0)
        count = self.ends[numbers] - begin if len(numbers) else np.zeros(0, np.int64)
        upto = np.cumsum(count)
        flat = self.ids[np.repeat(begin - upto + count, count) + np.arange(int(upto[-1]) if len(upto) else 0)]
        per_text = np.concatenate([[0], upto])[np.searchsorted(starts, text_ends)]
        if whole or end is not None:
            parts, at = [], 0
            tail = np.array([] if end is None else [end], self.kind)
            for k, stop in enumerate(per_text.tolist()):
                parts += [np.array(whole[k], self.kind) if k in whole else flat[at:stop], tail]
                at = stop
            per_text = np.cumsum([len(a) + len(b) for a, b in zip(parts[::2], parts[1::2])])
            flat = np.concatenate(parts) if parts else flat
        return flat, per_text

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0].tobytes()


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def tokenize(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids binary, n, order_key): ids with the end id, two or four bytes each by the
    vocabulary's size, their number, and the two rarest ids (BPE numbers frequent tokens first)."""

    def run(batches):
        encoder = word_encoder(path)
        for batch in batches:
            for part in portions(batch, 1, 1_000_000):
                flat, ends = encoder.encode_all([t or "" for t in part.column(1).to_pylist()], end_id)
                starts = np.concatenate([[0], ends[:-1]])
                counts = ends - starts
                most = np.maximum.reduceat(flat, starts)
                second = np.maximum.reduceat(np.where(flat == np.repeat(most, counts), 0, flat), starts)
                alone = np.minimum.reduceat(flat, starts) == most  # one id only
                keys = most.astype(np.int64) << 20 | np.where(alone, most, second).astype(np.int64)
                size = flat.itemsize
                ids = pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.append(0, ends * size).astype(np.int32)), pa.py_buffer(flat.tobytes())])
                yield pa.record_batch([part.column(0), ids, pa.array(counts), pa.array(keys)], names=["doc_id", "ids", "n", "order_key"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda batches: give_back(run(batches)), f"doc_id {kind}, ids binary, n long, order_key long")


def dealt_by_tokens(tokens: DataFrame, n_tokens: int, task_tokens: int = TASK_TOKENS) -> DataFrame:
    """(doc_id, ids) in tasks of about ``task_tokens`` ids, each sorted by order key and a salt.

    Documents lie together by their rarest id: neighbouring ids share a task, and an id whose documents hold more
    than a quarter of a task gets tasks of its own, dealt out by the salt. That is a hash of the id and tokens of a
    document, so copies are split like others; repeated rows are told apart by their place in the
    written table. The driver sees one sum of tokens per id of the vocabulary.
    """
    rarest = F.shiftright("order_key", 20)
    sums = tokens.groupBy(rarest.alias("rarest")).agg(F.sum("n").alias("n")).collect()
    places, part, held = [], 0, 0
    for row in sorted(sums, key=lambda r: r["rarest"]):
        own = row["n"] > task_tokens // 4
        if held and (own or held + row["n"] > task_tokens):
            part, held = part + 1, 0
        tasks = -(-row["n"] // task_tokens) if own else 1
        places.append((row["rarest"], part, tasks))
        part, held = (part + tasks, 0) if own else (part, held + row["n"])
    placed = tokens.sparkSession.createDataFrame(places, "rarest long, first int, tasks int")
    salt = F.xxhash64("doc_id", "ids", F.col("_metadata.row_index") % 4096)
    keyed = tokens.withColumn("salt", salt).withColumn("rarest", rarest).join(F.broadcast(placed), "rarest")  # at most a row per id
    keyed = keyed.withColumn("part", F.col("first") + F.pmod(F.col("salt"), F.col("tasks")).cast("int"))
    return keyed.repartitionById(max(1, part + 1), "part").sortWithinPartitions("order_key", "salt", "doc_id").select("doc_id", "ids")


def document_frequencies(tokens: DataFrame, size: int, kind: str) -> np.ndarray:
    """Documents that have each id; added up per task first. At most ``size`` rows reach the driver."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                total[np.unique(np.frombuffer(ids.as_py(), kind))] += 1
        at = np.nonzero(total)[0]
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["term", "n"])

    out = np.zeros(size, np.int64)
    for row in tokens.select("ids").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[row["term"]] = row["n"]
    return out


class ShardIndex:
    """A BM25 inverted index of one shard."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float):
        lengths = np.array([len(d) for d in docs])
        v = len(idf)
        keys = np.repeat(np.arange(len(docs)), lengths) * v + np.concatenate(docs).astype(np.int64)
        keys, tf = np.unique(keys, return_counts=True)
        owner, term = keys // v, keys % v
        by_term = np.argsort(term, kind="stable")
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[owner] / mean_length))
        self.n, self.docs, self.weights = len(docs), owner[by_term], weight[by_term]
        self.terms, self.first = np.unique(term[by_term], return_index=True)
        self.upto = np.append(self.first[1:], len(term))

    def scores(self, query: np.ndarray) -> np.ndarray:
        """BM25 scores of all documents for the distinct terms ``query``."""
        at = np.searchsorted(self.terms, query)
        at = at[at < len(self.terms)]
        at = at[np.isin(self.terms[at], query)]
        first, sizes = self.first[at], self.upto[at] - self.first[at]
        if not sizes.sum():
            return np.zeros(self.n)
        where = np.repeat(first - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        return np.bincount(self.docs[where], self.weights[where], minlength=self.n)


class Packer:
    """Fills windows from one shard after another; pieces are (doc, start, length, sequence, offset)."""

    def __init__(self, window: int, idf: np.ndarray, mean_length: float):
        self.window, self.idf, self.mean_length = window, idf, mean_length
        self.sequence = self.filled = 0
        self.seed: np.ndarray | None = None
        self.open: list = []

    def _add(self, doc, out: list) -> None:
        """Put a whole document in, cutting it at each window's end; its rest is the next seed."""
        number, ids = doc
        start = 0
        while start < len(ids):
            if not self.filled:
                self.seed = np.unique(ids)
            length = min(len(ids) - start, self.window - self.filled)
            self.open.append((number, start, length, len(ids), ids[start : start + length]))
            self.filled += length
            start += length
            if self.filled == self.window:
                self._flush(self.open, out)
                self.open, self.filled = [], 0

    def _flush(self, pieces, out: list) -> None:
        offset = 0
        for number, start, length, total, ids in pieces:
            out.append((number, start, length, total, self.sequence, offset, ids))
            offset += length
        self.sequence += 1

    def shard(self, docs: list) -> list:
        """Pack all documents [(number, ids), ...] of a shard."""
        out: list = []
        index = ShardIndex([ids for _, ids in docs], self.idf, self.mean_length)
        unused = np.ones(len(docs), bool)
        next_seed = 0
        while True:
            while next_seed < len(docs) and not unused[next_seed]:
                next_seed += 1
            if next_seed == len(docs):
                return out
            if not self.filled:
                unused[next_seed] = False
                self._add(docs[next_seed], out)
                continue
            scores = index.scores(self.seed)
            rest = np.nonzero(unused)[0]
            sequence = self.sequence
            for k in rest[np.argsort(-scores[rest], kind="stable")]:
                unused[k] = False
                self._add(docs[k], out)
                if self.sequence != sequence:
                    break

    def finish(self) -> list:
        """Split the window still open in power-of-two lengths, the longest first."""
        out: list = []
        pieces, self.open = self.open, []
        while self.filled:
            size = 1 << (self.filled.bit_length() - 1)
            own, left = [], size
            while left:
                number, start, length, total, ids = pieces.pop(0)
                if length > left:
                    pieces.insert(0, (number, start + left, length - left, total, ids[left:]))
                    length, ids = left, ids[:left]
                own.append((number, start, length, total, ids))
                left -= length
            self._flush(own, out)
            self.filled -= size
        return out


def pack_documents(
    docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids): one row per piece, ids as
    little-endian unsigned 32-bit integers. Every id of every document is in one piece.

    Null and empty texts are documents of the end id alone. Repeated rows and rows
    with a null id are packed like any other; an empty table gives an empty result;
    other columns are ignored.
    """
    encoder = word_encoder(path)
    kind, size = encoder.kind, encoder.size
    tokens = materialize(tokenize(docs, path, id_col, text_col, end_id), "packing-tokens")
    n_docs, n_tokens = tokens.agg(F.count("n"), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequency = document_frequencies(tokens, size, kind)
    idf = np.log1p((n_docs - frequency + 0.5) / (frequency + 0.5))
    mean_length = n_tokens / max(1, n_docs)

    def run(batches):
        packer = Packer(window, idf, mean_length)
        base = TaskContext.get().partitionId() << 32
        shard, held, id_kind = [], 0, None
        fields = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

        def emit(pieces):
            for at in range(0, len(pieces), 4096):
                names, starts, lengths, totals, sequences, offsets, ids = zip(*pieces[at : at + 4096])
                columns = [pa.array(names, id_kind), *(pa.array(c, pa.int64()) for c in (starts, lengths, totals))]
                columns += [pa.array([base + s for s in sequences], pa.int64()), pa.array(offsets, pa.int64())]
                yield pa.record_batch([*columns, pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary())], names=fields)

        for batch in batches:
            id_kind = batch.schema.field(0).type
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                numbers = np.frombuffer(ids.as_py(), kind)
                shard.append((doc, numbers))
                held += len(numbers)
                if held >= SHARD_TOKENS:
                    yield from emit(packer.shard(shard))
                    shard, held = [], 0
        if shard:
            yield from emit(packer.shard(shard))
        yield from emit(packer.finish())

    dealt = dealt_by_tokens(tokens, n_tokens)
    id_type = tokens.schema["doc_id"].dataType.simpleString()
    return dealt.mapInArrow(lambda batches: give_back(run(batches)), f"doc_id {id_type}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
