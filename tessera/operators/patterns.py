"""Which of many strings occur in which texts."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BYTES = 16 << 20  # patterns, with 64 bytes for each, that are sent to every task
GRAM = 3


def _by_automaton(texts: DataFrame, patterns: DataFrame, id_kind: str, key_kind: str) -> DataFrame:
    keys: dict[str, list] = {}
    for row in patterns.collect():  # of a checked size
        keys.setdefault(row["pattern"], []).append(row["pattern_id"])
    sent = texts.sparkSession.sparkContext.broadcast(keys)

    def run(batches):
        automaton = ahocorasick.Automaton()
        for pattern, owners in sent.value.items():
            automaton.add_word(pattern, owners)
        automaton.make_automaton()
        for batch in batches:
            rows, found = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                hits = {key for _, owners in automaton.iter(text) for key in owners} if text else set()
                rows += [k] * len(hits)
                found += hits
            yield pa.record_batch([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, key_type)], names=["id", "pattern_id"])

    key_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[key_kind]
    if not keys:
        return texts.select("id", F.lit(None).cast(key_kind).alias("pattern_id")).where("false")
    return texts.mapInArrow(run, f"id {id_kind}, pattern_id {key_kind}").distinct()


def _grams(rows: DataFrame, sizes: list[int], kind: str, whole: bool) -> DataFrame:
    """(id, gram): distinct strings of each size in a text; of a text shorter than the least size itself, if ``whole``."""

    def run(batches):
        for batch in batches:
            for k, text in enumerate(batch.column(1).to_pylist()):
                own = [min(GRAM, len(text))] if whole else sizes
                grams = sorted({text[i : i + n] for n in own for i in range(len(text) - n + 1)})
                yield pa.record_batch([batch.column(0).take(pa.array([k] * len(grams), pa.int64())), pa.array(grams, pa.string())], names=["id", "gram"])

    return rows.mapInArrow(run, f"id {kind}, gram string")


def _by_rarest_gram(texts: DataFrame, patterns: DataFrame, id_kind: str, key_kind: str) -> DataFrame:
    sizes = [r[0] for r in patterns.select(F.least(F.length("pattern"), F.lit(GRAM))).distinct().collect()]  # three values at most
    parts = _grams(patterns.select(F.col("pattern_id").alias("id"), "pattern"), sizes, key_kind, True).withColumnRenamed("id", "pattern_id")
    in_texts = _grams(texts, sizes, id_kind, False).join(parts.select("gram").distinct(), "gram", "left_semi")
    frequent = in_texts.groupBy("gram").agg(F.count("*").alias("n"))
    # one gram a pattern; a pattern with a gram that no text has can't occur
    ranked = parts.join(frequent, "gram", "left").groupBy("pattern_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g")).where("g.n > 0")
    dealt = patterns.join(ranked.select("pattern_id", "g.gram"), "pattern_id")
    pairs = in_texts.join(dealt, "gram").select("id", "pattern_id", "pattern")
    return texts.join(pairs, "id").where(F.contains("text", F.col("pattern"))).select("id", "pattern_id").distinct()


def found_in(texts: DataFrame, patterns: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Distinct (id, pattern_id) of texts(id, text) that contain a pattern of patterns(pattern_id, pattern), letter by letter.

    Up to ``most_bytes`` of patterns go to each task as one automaton, which reads a text once whatever their number. More are dealt out
    by the string of three letters of theirs that the fewest texts hold (themselves, if shorter), and only texts that hold it are compared.
    Both give the same rows. Null and empty patterns, null texts and null ids have none; one pattern_id may have one pattern
    only, of repeated ones the greater counts; other columns are ignored.
    """
    texts = texts.select("id", F.col("text").cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    patterns = patterns.where("pattern <> '' AND pattern_id IS NOT NULL").groupBy("pattern_id").agg(F.max("pattern").alias("pattern"))
    size = patterns.agg(F.coalesce(F.sum(F.octet_length("pattern") + 64), F.lit(0))).first()[0]
    kinds = texts.schema["id"].dataType.simpleString(), patterns.schema["pattern_id"].dataType.simpleString()
    return (_by_automaton if size <= most_bytes else _by_rarest_gram)(texts, patterns, *kinds)
