"""Documents as lines: code sweeps, search, furniture, coverage, checksums, conversation steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CODE = r"\b[PCBU][0-9][0-9A-F]{3}\b"


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no, line): all lines, counted from 1."""
    return docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("p", "line")).select("id", (F.col("p") + 1).alias("line_no"), "line")


def code_sweep(docs: DataFrame, pattern: str = CODE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(code, n, n_docs): normalised codes in whole texts, how often and in how many documents."""
    found = F.explode(F.regexp_extract_all(F.upper(F.col(text_col)), F.lit(pattern), F.lit(0))).alias("code")
    return docs.select(F.col(id_col).alias("id"), found).groupBy("code").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_docs"))


def literal_search(docs: DataFrame, phrase: str, preview: int = 110) -> DataFrame:
    """(id, line_no, preview): lines that hold a phrase, case aside."""
    return lines(docs).where(F.contains(F.lower("line"), F.lit(phrase.lower()))).select("id", "line_no", F.substring("line", 1, preview).alias("preview"))


def furniture(docs: DataFrame, more_than: int = 20, least_chars: int = 4) -> DataFrame:
    """(line, n_docs): trimmed lines of more than ``more_than`` documents."""
    x = lines(docs).select("id", F.trim("line").alias("line")).where(F.length("line") >= least_chars)
    return x.groupBy("line").agg(F.countDistinct("id").alias("n_docs")).where(F.col("n_docs") > more_than)


def coverage(baseline: DataFrame, emitted: DataFrame) -> DataFrame:
    """(n_lines, n_missing, recall) of baseline(line) against emitted(line): an anti-join on distinct lines, by characters."""
    wanted = baseline.groupBy("line").agg(F.count("*").alias("n"))
    there = emitted.select("line").distinct().withColumn("found", F.lit(True))
    x = wanted.join(there, "line", "left")
    lost = F.col("found").isNull()
    return x.agg(
        F.sum("n").alias("n_lines"), F.coalesce(F.sum(F.when(lost, F.col("n"))), F.lit(0)).alias("n_missing"),
        (1 - F.coalesce(F.sum(F.when(lost, F.col("n") * F.length("line"))), F.lit(0)) / F.sum(F.col("n") * F.length("line"))).alias("recall"),
    )


def iterations(turns: DataFrame) -> DataFrame:
    """(conv_id, iteration, n_turns, n_chars) of turns(conv_id, turn, role, text, calls_tools): an
    assistant's turn that calls tools opens a step and what follows belongs to it, until the next
    one or a plain assistant turn, which closes it. Turns outside of steps are left out."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    assistant, calls = F.col("role") == "assistant", F.coalesce("calls_tools", F.lit(False))
    x = turns.withColumn("step", F.when(assistant, calls)).withColumn("mark", F.sum(assistant.cast("int")).over(order))
    steps = x.groupBy("conv_id", "mark").agg(F.max("step").alias("step"), F.count("*").alias("n_turns"), F.sum(F.length("text")).alias("n_chars")).where("step")
    return steps.withColumn("iteration", F.row_number().over(Window.partitionBy("conv_id").orderBy("mark")).cast("long")).select("conv_id", "iteration", "n_turns", "n_chars")


def paragraph_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_index, chunk, checksum): paragraphs, each with the digest of its document, number and text."""
    x = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("chunk_index", "chunk")).where(F.trim("chunk") != "")
    key = F.concat_ws(":", F.col("id").cast("string"), F.col("chunk_index").cast("string"), F.col("chunk"))
    return x.withColumn("checksum", F.sha2(key, 256))
