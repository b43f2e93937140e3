"""A stored inverted index for keyword search, read by blocks that can still reach the first k.

``build`` writes two tables: postings (term, block, id, tf, n_words, positions) and headers (term, block, n, most), the number of a term's postings in a
block and their greatest share of a text's words. A block holds texts of about one length, as the share falls with it, and about
``BLOCK_TEXTS`` of them. Both are dealt out by term and block, so a term of all texts is split by blocks, and each file is sorted by
them, so a filter on terms prunes row groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_TEXTS = 1024
TEXTS_AT_ONCE = 512  # texts that a task makes postings of at a time
SLACK = 1e-9  # bounds are sums in doubles


def _postings(rows: DataFrame) -> DataFrame:
    """(term, block, id, tf, n_words, positions) of rows(block, id, n_words, w): the terms of a text with their places, made
    where the text is read, so that only whole postings are shuffled."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                sizes = part.column(3).value_lengths().to_numpy(zero_copy_only=False)
                words = part.column(3).flatten().dictionary_encode()
                codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                place = (np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
                kept = np.nonzero(np.array([t != "" for t in words.dictionary.to_pylist()], bool)[codes])[0] if len(codes) else codes
                key = owner[kept] * (len(words.dictionary) + 1) + codes[kept]
                order = np.argsort(key, kind="stable")
                starts = np.nonzero(np.append(True, np.diff(key[order]) != 0)[: len(key)])[0]
                first = kept[order[starts]]
                ends = np.append(starts, len(key)).astype(np.int32)
                block, id_, n_words = (part.column(k).take(pa.array(owner[first])) for k in range(3))
                columns = [words.dictionary.take(pa.array(codes[first])), block, id_, pa.array(np.diff(ends)), n_words, pa.ListArray.from_arrays(pa.array(ends), pa.array(place[kept[order]]))]
                yield pa.record_batch(columns, names=["term", "block", "id", "tf", "n_words", "positions"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("block", "id", "n_words", "w").mapInArrow(run, f"term string, block long, id {kind}, tf int, n_words int, positions array<int>")


def build(chunks: DataFrame, path: str, id_col: str, text_col: str, block_texts: int = BLOCK_TEXTS) -> None:
    """Write the index of ``chunks`` to ``path``. Words are runs of letters and digits of ASCII, case aside; a null text has none. Ids are
    not null; rows with one id must be told apart by the caller."""
    words = F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^a-z0-9]+")
    x = chunks.select(F.col(id_col).alias("id"), words.alias("w")).where("id IS NOT NULL").withColumn("n_words", F.size("w"))
    x = x.withColumn("class", F.floor(4 * F.log2("n_words")))
    classes = x.groupBy("class").agg(F.ceil(F.count("*") / block_texts).alias("blocks"))  # four rows a doubling of length
    x = x.join(F.broadcast(classes), "class").withColumn("block", F.shiftleft(F.col("class"), 32) + F.pmod(F.xxhash64("id"), F.col("blocks")))
    # dealt out by hash: ranges would need the postings made once more for their bounds
    _postings(x).repartition("term", "block").sortWithinPartitions("term", "block", "id").write.parquet(f"{path}/postings")
    stored = chunks.sparkSession.read.parquet(f"{path}/postings")
    headers = stored.groupBy("term", "block").agg(F.count("*").alias("n"), F.max(F.col("tf") / F.col("n_words")).alias("most"))
    headers.sortWithinPartitions("term", "block").write.parquet(f"{path}/headers")


class KeywordIndex:
    """An index that ``build`` has written."""

    def __init__(self, spark: SparkSession, path: str):
        self.postings = spark.read.parquet(f"{path}/postings")
        self.headers = spark.read.parquet(f"{path}/headers")

    def bounds(self, tokens: list[str]) -> DataFrame:
        """(block, bound): no text of the block has a greater rank for an OR of ``tokens``; blocks with a hit only."""
        heads = self.headers.where(F.col("term").isin(*tokens))
        return heads.groupBy("block").agg((F.count("*") + F.sum("most") + SLACK).alias("bound"))

    def _ranked(self, postings: DataFrame) -> DataFrame:
        hits = postings.groupBy("id").agg(F.count("*").alias("n"), F.sum("tf").alias("hits"), F.first("n_words").alias("n_words"))
        return hits.select("id", (F.col("n") + F.col("hits") / F.col("n_words")).alias("rank"))

    def within_reach(self, tokens: list[str], k: int) -> DataFrame:
        """Postings of ``tokens`` in the blocks that can hold one of the first k.

        The k blocks with the greatest bounds are read first. Each has a hit, so their k-th rank is a lower limit; blocks whose bound
        reaches it are read besides, with equal ones for the sake of ties.
        """
        tokens = sorted(set(tokens))
        mine, bounds = self.postings.where(F.col("term").isin(*tokens)), self.bounds(tokens)
        first = [r["block"] for r in bounds.orderBy(F.desc("bound"), "block").limit(k).collect()]
        if len(first) < k:  # these are all blocks with a hit
            return mine
        best = self._ranked(mine.where(F.col("block").isin(*first))).orderBy(F.desc("rank")).limit(k).collect()
        limit = best[-1]["rank"]
        return mine.join(bounds.where(F.col("bound") >= limit).select("block"), "block", "left_semi")

    def top_k(self, tokens: list[str], k: int) -> DataFrame:
        """(id, rank): the k texts of the greatest rank as ``retrieval.keyword_scores`` gives it, ties to the smaller id. No token, no hit."""
        if k < 1:
            raise ValueError("k must be 1 or more")
        return self._ranked(self.within_reach([t.lower() for t in tokens], k)).orderBy(F.desc("rank"), "id").limit(k)

    def phrase(self, tokens: list[str]) -> DataFrame:
        """(id, n): the texts that hold ``tokens`` one after another, and how often; words are told apart by anything that is none."""
        places = F.array(*[F.struct(F.lit(t.lower()).alias("term"), F.lit(i).alias("offset")) for i, t in enumerate(tokens)])
        if not tokens:
            return self.postings.select("id", F.lit(0).cast("long").alias("n")).where("false")
        mine = self.postings.where(F.col("term").isin(*[t.lower() for t in tokens])).select("id", "term", "positions")
        wanted = F.filter(places, lambda p: p["term"] == F.col("term"))
        begins = mine.select("id", F.explode(F.flatten(F.transform(wanted, lambda p: F.transform("positions", lambda q: q - p["offset"])))).alias("begin"))
        return begins.groupBy("id", "begin").agg(F.count("*").alias("found")).where(F.col("found") == len(tokens)).groupBy("id").agg(F.count("*").alias("n"))
