"""SimHash near-duplicates found with Golay-code fuzzy keys.

A document's fingerprint has 64 bits, the majority over the XXH64 values of its
word shingles. Two fingerprints link when they differ in at most two bits.

Candidates. The 64 bits are cut in segments of 21, 21 and 22 bits. Two differing
bits leave at least one segment untouched (pigeonhole), and the segment after it
has at most two errors. That one, padded to 23 bits, is decoded with the perfect
binary Golay code (23, 12, 7): a word's keys are the indices of all codewords at
distance 4 or less, one or six of them. If two words differ in at most two bits,
the word halfway between them lies within 3 of some codeword, which then lies
within 4 of both: they share a key. A bucket is (untouched segment, key), 33 bits
in all; pairs in a bucket are verified by the Hamming distance.

Large buckets. A bucket of more than ``MAX_BUCKET`` distinct fingerprints is not
paired: each of its fingerprints instead names the 65 words at distance 1 or less
(hubs) and links to the smallest fingerprint that names the same hub. Two
fingerprints share a hub exactly when they differ in two bits or fewer, so this
is exact and linear in the bucket's size.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialize

SEED = 42
SEGMENTS = ((0, 21), (21, 21), (42, 22))  # (lowest bit, width)
GENERATOR = 0b101011100011  # of the Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
MAX_BUCKET = 96
BLOCK = 1 << 16


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit SimHash of a whole text; 0 for a null text or one without words."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII spaces split
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    last = max(1, len(words) - width + 1)
    reach = min(width, len(words)) - 1
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, last, BLOCK):
        upto = min(last, at + BLOCK)
        hashes = np.array(
            [digest(joined[a : b - 1], SEED) for a, b in zip(starts[at:upto], ends[at + reach : upto + reach])], ">u8"
        )
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > last).view(">u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row as a signed long."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _golay():
    """Remainder tables for each byte of a word, and for each of the 2,048
    remainders its error patterns of weight 4 or less (-1: none)."""

    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    single = [remainder(1 << b) for b in range(23)]
    by_byte = np.zeros((3, 256), np.int64)
    for k, value in itertools.product(range(3), range(256)):
        for b in range(8):
            if value >> b & 1 and 8 * k + b < 23:
                by_byte[k, value] ^= single[8 * k + b]
    patterns = np.full((2048, 6), -1, np.int64)
    filled = [0] * 2048
    for weight in range(5):
        for bits in itertools.combinations(range(23), weight):
            rest = 0
            for b in bits:
                rest ^= single[b]
            patterns[rest, filled[rest]] = sum(1 << b for b in bits)
            filled[rest] += 1
    return by_byte, patterns


_TABLES: list = []


def golay_keys(words: np.ndarray) -> np.ndarray:
    """(n, 6) indices of the codewords within distance 4 of 23-bit words; -1 fills."""
    if not _TABLES:
        _TABLES.extend(_golay())
    by_byte, patterns = _TABLES
    rest = by_byte[0, words & 255] ^ by_byte[1, words >> 8 & 255] ^ by_byte[2, words >> 16 & 255]
    errors = patterns[rest]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> 11)


def bucket_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, positions in ``fps``): every bucket of every fingerprint."""
    fps = fps.view(np.uint64)
    keys, owners = [], []
    for s, (low, width) in enumerate(SEGMENTS):
        near, near_width = SEGMENTS[(s + 1) % 3]
        exact = (fps >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64)
        word = (fps >> np.uint64(near) & np.uint64((1 << near_width) - 1)).astype(np.int64)
        index = golay_keys(word)
        key = (np.int64(s) << 40) | (exact[:, None] << 12) | index
        at = np.nonzero(index >= 0)
        keys.append(key[at])
        owners.append(at[0])
    return np.concatenate(keys), np.concatenate(owners)


def _keyed(unique: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            keys, owners = bucket_keys(fps)
            yield pa.record_batch([pa.array(keys), pa.array(fps[owners])], names=["key", "fp"])

    return unique.select("fp").mapInArrow(run, "key long, fp long")


def links(unique: DataFrame, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(a, b) with a < b: pairs of distinct fingerprints at two bits or fewer.

    Small buckets give every such pair. For members of large buckets the pairs
    connect the same fingerprints, but only as stars around hubs.
    """
    keyed = materialize(_keyed(unique), "simhash-keys")
    sizes = keyed.groupBy("key").count()
    large = sizes.where(F.col("count") > max_bucket).select("key")
    shared = sizes.where(F.col("count").between(2, max_bucket)).select("key")
    small = keyed.join(shared, "key", "left_semi")
    a, b = small.alias("a"), small.alias("b")
    pairs = a.join(
        b,
        (F.col("a.key") == F.col("b.key"))
        & (F.col("a.fp") < F.col("b.fp"))
        & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= 2),
    ).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    masks = [0, *(1 << b if b < 63 else -(1 << 63) for b in range(64))]
    hubs = (
        keyed.join(large, "key", "left_semi")
        .select("fp")
        .distinct()
        .select("fp", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask"))
        .select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("hub"))
    )
    centre = hubs.groupBy("hub").agg(F.min("fp").alias("a"), F.count("fp").alias("n")).where("n > 1")
    stars = hubs.join(centre, "hub").where(F.col("a") < F.col("fp")).select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component, for nodes of ``edges(a, b)``.

    Alternates large-star and small-star steps until a round changes nothing, which
    takes a number of rounds logarithmic in the component's size (squared at worst);
    each round is a written table and the driver sees only a count and a checksum. The
    minimum per node is a combined aggregate joined back, so a node with very many
    links is never one task's list.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc")
    state = None
    while True:
        seen = tuple(now.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == state or not seen[0]:
            break
        state = seen
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "cc-large")
        discard(now)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        now = materialize(small, "cc-small")
        discard(large)
    roots = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    component_id is the smallest id reachable over links. Null texts and texts
    without words have fingerprint zero and link like any other. Repeated rows
    come back as often as they occur; rows with a null id take part and get their
    component's id (null only if no member has one). An empty table gives an
    empty result. Columns besides the two named are ignored.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, width), "simhash-fp")
    unique = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-unique")
    roots = connected(links(unique))
    classes = unique.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = classes.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = classes.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def hex64(col) -> "F.Column":
    return F.lower(F.lpad(F.hex(col), 16, "0"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, grouped=None) -> DataFrame:
    """One row of ``docs`` for each component of its texts, the one with the smallest id, all columns kept.

    ``grouped`` gives the component_id of each row of a (doc_id, text) table, by
    default that of ``near_duplicates`` with shingles of ``width`` words. It gets the
    texts' hashes as ids, so rows without an id and rows that share one are placed by
    their texts. A null id comes after all others; rows of one id in one component
    stay once, the one with the smallest hash of its text.
    """
    of, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    texts = docs.select(F.xxhash64(text).alias("doc_id"), text.alias("text"))
    found = grouped(texts) if grouped else near_duplicates(texts, width=width)
    placed = found.select(F.col("doc_id").alias("text_hash"), "component_id").distinct()
    key = ["none", "id", "text_hash"]
    rows = docs.select(of.isNull().alias("none"), F.coalesce(of, F.lit(0)).alias("id"), F.xxhash64(text).alias("text_hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    # the first row of each text and then of each component, so that a text with very many copies is no task's list
    first = rows.groupBy("text_hash").agg(F.min(F.struct("none", "id")).alias("at")).join(placed, "text_hash")
    leads = first.groupBy("component_id").agg(F.min(F.struct("at.none", "at.id", "text_hash")).alias("lead")).select("lead.*")
    # one row a key before any is sent, so that a repeated row is no task's list either
    order = Window.partitionBy(key).orderBy(f"row.`{text_col}`")
    return rows.withColumn("nth", F.row_number().over(order)).where("nth = 1").join(leads, key, "left_semi").select("row.*")
