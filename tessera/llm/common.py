"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, ``spark.checkpoint.dir``.

    Only a local session without that setting, as in tests, gets a folder of its own;
    on a cluster a machine's own folder would be out of the others' reach.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    return context.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut lineage that
    survives lost executors and costs compressed columnar bytes only."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tessera/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.scratch_path = path
    return written


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and nothing reads any more."""
    for t in tables:
        context = t.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        release(tables[0])


def release(df: DataFrame) -> None:
    """Let Spark delete the shuffle files of steps that are over: it does so when the driver collects garbage,
    which with a large heap may be long after."""
    trim()
    df.sparkSession.sparkContext._jvm.System.gc()


def trim() -> None:
    """Return the memory that this process holds but no longer uses."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        pass


def give_back(batches):
    """The batches, and then the memory they took: Python workers outlive their task."""
    yield from batches
    trim()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id) -> "F.Column":
    """True for the rows no classifier may learn from: crc32(id as text) mod 3 = 1."""
    return (F.crc32(doc_id.cast("string")) % 3) == 1


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, class_bytes: int = 24_000_000) -> list:
    """Up to ``per_class`` labelled (id, label, text) rows of each class, rows held out excluded.

    The rows are those with the smallest hash of their id, so the choice is the same on
    every run. ``per_class`` rows and ``class_bytes`` of text a class bound what reaches
    the driver: of repeated rows of an id one text counts (the smallest hash), and the
    texts that the bytes have no room for are left out, in the order of the hash. Rows
    with a null id, text or label are left out; an id labelled both ways counts once a label.
    """
    ids = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y")).where(
        F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & ~held_out(F.col("_id"))
    ).distinct()
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("_t")).where(F.col("_t").isNotNull())
    present = ids.join(texts.select("_id").distinct(), "_id", "left_semi")
    chosen = None
    for y in (0, 1):
        part = present.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most 2 * per_class rows of two numbers, which is the bound of this broadcast
    rows = texts.join(F.broadcast(chosen), "_id").groupBy("_id", "_y").agg(F.min_by("_t", F.struct(F.xxhash64("_t"), "_t")).alias("_t"))
    order = Window.partitionBy("_y").orderBy(F.xxhash64("_id"), "_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_upto", F.sum(F.octet_length("_t")).over(order)).where(F.col("_upto") <= class_bytes)
    return sorted((r["_id"], r["_y"], r["_t"]) for r in rows.select("_id", "_y", "_t").collect())


def portions(batch, column: int, max_bytes: int):
    """Slices of an Arrow batch with about ``max_bytes`` of text each, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum([n or 0 for n in pc.binary_length(batch.column(column)).to_pylist()])
    first = 0
    while first < len(ends):
        upto = int(np.searchsorted(ends, (ends[first - 1] if first else 0) + max_bytes, "right"))
        upto = max(first + 1, upto)
        yield batch.slice(first, upto - first)
        first = upto


def map_texts(docs: DataFrame, id_col: str, text_col: str, score, schema: str, max_bytes: int = 2_000_000) -> DataFrame:
    """Apply ``score(texts) -> list of Arrow arrays`` to all rows, a few MB of text at a time.

    The result has the id column as ``doc_id`` and the columns of ``schema``. Null
    texts are passed as empty strings; other columns are ignored.
    """
    names = ["doc_id", *(c.split()[0] for c in schema.split(","))]

    def run(batches):
        for batch in batches:
            for part in portions(batch, 1, max_bytes):
                texts = [t or "" for t in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), *score(texts)], names=names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, {schema}")


def fit_logistic(x, y, l2: float = 1e-2, rounds: int = 40):
    """Weights (bias last) of a logistic regression, by Newton's method."""
    import numpy as np

    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + l2 * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def text_column(score, kind: str, max_bytes: int = 300_000):
    """A column function of a text column; ``score(texts)`` gives one value for each of a list of texts."""
    def run(texts: pd.Series) -> pd.Series:
        values = [t or "" for t in texts.tolist()]
        out, first, held = [], 0, 0
        for k, t in enumerate(values):
            held += len(t)
            if held >= max_bytes:
                out += list(score(values[first : k + 1]))
                first, held = k + 1, 0
        if first < len(values):
            out += list(score(values[first:]))
        return pd.Series(out, dtype="int32" if kind == "int" else None)

    return F.pandas_udf(run, kind)
