"""Byte-level BPE by speculation and verification.

A text is cut in words by the vocabulary's own pre-tokenizer. For each new word
greedy longest match proposes tokens. Adjacent tokens are compatible when BPE of
their joined bytes gives these two tokens again; a sequence in which every
adjacent pair is compatible, and every token encodes to itself, is the BPE
encoding. The pairs of all new words are tested together against sorted arrays of
judged pairs; pairs not judged yet are judged once by exact merging. Words with an
incompatible pair, and only these, are merged exactly.

Judged pairs and encoded words are kept by each Python worker, up to ``PAIRS`` and
about ``CACHE`` entries; a worker that has more forgets the older ones.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

CACHE = 600_000
PAIRS = 1_000_000
SLICE = 200_000
SHORT = 40  # bytes of a word that is merged without a heap
BATCH_CHARS = 4_000_000
_ID = (1 << 24) - 1
_TAIL = ".,;:!?"
_LATIN_END = "\u02b0"  # all letters below are letters in every version of Unicode
_DOUBLE_SPACE = re.compile(r"\s\s")


def byte_letters() -> dict[str, int]:
    """The printable letter by which a byte-level vocabulary file writes each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class SpeculativeBpe:
    """Encoder and decoder for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = file.read()
        spec = json.loads(content)
        letters = byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {k: v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        self.ids = {as_bytes(k): v for k, v in vocab.items()}
        self.bytes_of: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, number in self.ids.items():
            self.bytes_of[number] = token
        for token, number in self.special.items():
            self.bytes_of[number] = token.encode()
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks = {}
        for rank, (a, b) in enumerate(pairs):
            self.ranks[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.size = len(self.bytes_of)
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        self.orders = {pair: rank << 24 | new for pair, (rank, new) in self.ranks.items()}
        self.cut = Tokenizer.from_str(content).pre_tokenizer.pre_tokenize_str
        self.letters = letters
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.known: dict[str, bytes] = {}  # ids of words, and of chunks of several words
        self.reach: dict[bytes, int] = {}  # by its first two bytes, the length of the longest token
        for token in self.ids:
            if len(token) > 1:
                self.reach[token[:2]] = max(len(token), self.reach.get(token[:2], 0))
        self.judged, self.fits = np.array([-1]), np.array([False])  # sorted pair codes, and the verdicts
        self.selfless = {n for token, n in self.ids.items() if self.merge(token) != [n]}

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: always the pair of lowest rank, leftmost first."""
        ids = list(map(self.byte_ids.__getitem__, word))
        if len(ids) < 2:
            return ids
        if len(ids) <= SHORT:
            return self._merge_short(ids)
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        ranks = self.ranks
        heap = [(ranks[pair][0], k, ranks[pair][1], *pair) for k, pair in enumerate(zip(ids, ids[1:])) if pair in ranks]
        heapq.heapify(heap)
        while heap:
            _, k, new, a, b = heapq.heappop(heap)
            other = after[k]
            if ids[k] != a or other >= len(ids) or ids[other] != b:
                continue  # one of the two has been merged since
            ids[k], ids[other] = new, -1
            after[k] = after[other]
            if after[k] < len(ids):
                before[after[k]] = k
                if found := self.ranks.get((new, ids[after[k]])):
                    heapq.heappush(heap, (found[0], k, found[1], new, ids[after[k]]))
            if (left := before[k]) >= 0 and (found := self.ranks.get((ids[left], new))):
                heapq.heappush(heap, (found[0], left, found[1], ids[left], new))
        return [n for n in ids if n >= 0]

    def _merge_short(self, ids: list[int]) -> list[int]:
        """The same without a heap: the least of a short list is found faster than kept."""
        get, never = self.orders.get, 1 << 60
        orders = [get(pair, never) for pair in zip(ids, ids[1:])]
        while orders and (least := min(orders)) != never:
            k = orders.index(least)
            new = least & _ID
            ids[k : k + 2] = (new,)
            del orders[k]
            if k < len(orders):
                orders[k] = get((new, ids[k + 1]), never)
            if k:
                orders[k - 1] = get((ids[k - 1], new), never)
        return ids

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, at, ids, reach, end = [], 0, self.ids, self.reach, len(word)
        while at < end:
            for upto in range(min(end, at + reach.get(word[at : at + 2], 1)), at, -1):
                if (found := ids.get(word[at:upto])) is not None:
                    out.append(found)
                    at = upto
                    break
        return out

    def compatible(self, codes: np.ndarray) -> np.ndarray:
        """For pairs coded first * size + second: whether both tokens survive side by side."""
        unique, back = np.unique(codes, return_inverse=True)
        at = np.searchsorted(self.judged, unique)
        new = unique[self.judged[np.minimum(at, len(self.judged) - 1)] != unique]
        if len(new):
            fits = [self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b] for a, b in (divmod(int(c), self.size) for c in new)]
            if len(self.judged) > PAIRS:  # those of this batch stay
                stay = np.zeros(len(self.judged), bool)
                stay[0] = True
                stay[at[self.judged[np.minimum(at, len(self.judged) - 1)] == unique]] = True
                self.judged, self.fits = self.judged[stay], self.fits[stay]
            place = np.searchsorted(self.judged, new)
            self.judged, self.fits = np.insert(self.judged, place, new), np.insert(self.fits, place, fits)
            at = np.searchsorted(self.judged, unique)
        return self.fits[at][back]

    def learn(self, new: list[str]) -> None:
        """Encode words not seen before."""
        words = [w.encode() for w in new]
        proposed = [self.propose(w) for w in words]
        flat = np.fromiter((n for p in proposed for n in p), np.int64)
        sizes = np.array([len(p) for p in proposed])
        ends = np.cumsum(sizes)
        inner = np.ones(len(flat), bool)
        inner[ends - 1] = False  # the pair that starts at a word's last token crosses words
        where = np.nonzero(inner)[0]
        wrong = np.zeros(len(flat), bool)
        if len(where):
            wrong[where] = ~self.compatible(flat[where] * self.size + flat[where + 1])
        if self.selfless:
            wrong |= np.isin(flat, list(self.selfless))
        failing = np.logical_or.reduceat(wrong, ends - sizes)
        for name, word, ids, fails in zip(new, words, proposed, failing):
            ids = self.merge(word) if fails else ids
            self.known[name] = struct.pack(f"<{len(ids)}I", *ids)

    def _words(self, chunk: str) -> list[str]:
        """A chunk's words. Plain letters, with marks after them or between lines, are cut here as
        the pre-tokenizer would; it gets the rest."""
        out = []
        for k, line in enumerate(chunk.split("\n")):
            if k:
                out.append("\n")
            body = line[1:] if line[:1] == " " and not k else line
            core = body.rstrip(_TAIL)
            if not core.isalpha() or not (core.isascii() or max(core) < _LATIN_END):
                letters = self.letters
                return [bytes(map(letters.__getitem__, piece)).decode() for piece, _ in self.cut(chunk)] if chunk else []
            marks = len(body) - len(core)
            out.append(line[: len(line) - marks])
            if marks:
                out.append(body[-marks:])
        return out

    def _learn_chunks(self, chunks: list[str]) -> None:
        known = self.known
        cut = list(map(self._words, chunks))
        if new := list(dict.fromkeys(w for ws in cut for w in ws if w not in known)):
            self.learn(new)
        for chunk, ws in zip(chunks, cut):
            if len(ws) != 1:
                known[chunk] = b"".join([known[w] for w in ws])

    def _chunks(self, text: str) -> list[str]:
        # Words never span a single space between two other characters; runs of white space are cut whole.
        if _DOUBLE_SPACE.search(text):
            return _split_runs(text)
        first, *rest = text.split(" ")
        return [first, *[" " + c for c in rest]]

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk; ``SLICE`` at a time, which bounds the caches for very long texts too."""
        known, out = self.known, []
        for at in range(0, len(chunks), SLICE):
            part = chunks[at : at + SLICE]
            if len(known) > CACHE:
                known.clear()
            if new := [c for c in dict.fromkeys(part) if c not in known]:
                self._learn_chunks(new)
            out += map(known.__getitem__, part)
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers."""
        chunks, spans = [], []
        for text in texts:
            if self.split_special is None or not self.split_special.search(text):
                chunks += (own := self._chunks(text))
                spans.append((len(own),))
            else:
                span = []
                for k, part in enumerate(self.split_special.split(text)):
                    if k % 2:
                        span.append(self.special[part].to_bytes(4, "little"))
                    elif part:
                        chunks += (own := self._chunks(part))
                        span.append(len(own))
                spans.append(span)
        ids, at, out = self._encode_chunks(chunks), 0, []
        for span in spans:
            parts = []
            for x in span:
                if isinstance(x, int):
                    parts += ids[at : at + x]
                    at += x
                else:
                    parts.append(x)
            out.append(b"".join(parts))
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]

    def decode(self, ids: bytes) -> str:
        """Text of little-endian ids, special tokens included."""
        joined = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return joined.decode("utf-8", "replace")


def _split_runs(text: str) -> list[str]:
    """Cut before each single space between two non-space characters."""
    return re.split(r"(?<=\S)(?= \S)", text)


def _portions(batch: pa.RecordBatch):
    """Slices of a batch of about BATCH_CHARS bytes of text, one row at least."""
    sizes = np.cumsum([0 if n is None else n for n in pc.binary_length(batch.column(1)).to_pylist()])
    first = 0
    while first < len(sizes):
        upto = int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + BATCH_CHARS, "right"))
        yield batch.slice(first, max(1, upto - first))
        first = max(first + 1, upto)


_ENCODERS: dict[str, SpeculativeBpe] = {}


def encoder(path: str) -> SpeculativeBpe:
    """The worker's encoder for a vocabulary file; the file lies on every machine."""
    if path not in _ENCODERS:
        _ENCODERS[path] = SpeculativeBpe(path)
    return _ENCODERS[path]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary): token ids of every whole text, little-endian unsigned 32-bit.

    Null and empty texts give no ids. Repeated rows and rows with a null id are
    encoded like any other; an empty table gives an empty result; other columns
    are ignored. A text's ids are held whole by one task, texts one after another.
    """

    def run(batches):
        bpe = encoder(path)
        for batch in batches:
            for part in _portions(batch):
                ids = bpe.encode_batch([t or "" for t in part.column(1).to_pylist()])
                yield pa.record_batch([part.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids binary")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text): the decoded text of ``encoded(doc_id, ids)``; null ids give the empty text."""

    def run(batches):
        bpe = encoder(path)
        for batch in batches:
            texts = [bpe.decode(x.as_py() or b"") for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids binary, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, and the digests of its ids and of the text decoded from them."""
    both = decode_documents(encode_documents(docs, path, id_col, text_col), path)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"),
    )
