"""Structured Streaming forms of the signal operators.

Sources are tables of signal rows (session, signal, ts, row_id, value) that grow by files. What a
stream writes goes to Parquet below the shared folder, with its checkpoint beside it, so a
restarted query goes on where it stopped and writes no row twice.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.sources import logs


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; only a local session may lack that setting."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="tessera-stream-")
    return f"{shared.rstrip('/')}/tessera/{name}-{uuid.uuid4().hex}"


def drained(stream: DataFrame, path: str) -> DataFrame:
    """Append what a stream has now to ``path`` and read it back; the checkpoint is at ``{path}/_checkpoint``."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", f"{path}/_checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def gridded(rows: DataFrame, seconds: int = 1, lateness: str = "10 seconds") -> DataFrame:
    """(session, signal, start, value, n): means on a grid of time, each written once when it is closed. Rows
    later than ``lateness`` are left out (X8); the source's batch forms have no such limit."""
    x = rows.where(F.col("value").isNotNull() & ~F.isnan("value")).withWatermark("ts", lateness)
    out = x.groupBy(F.window("ts", f"{seconds} seconds").alias("w"), "session", "signal").agg(F.avg("value").alias("value"), F.count("*").alias("n"))
    return out.select("session", "signal", F.col("w.start").alias("start"), "value", "n")


def events_above(rows: DataFrame, threshold: float, gap_seconds: float, lateness: str = "10 seconds") -> DataFrame:
    """(session, signal, start, end, peak, n): rows above a threshold, less than the gap apart, as one event, written
    when the gap has passed. ``end`` is the last row's time, not that time and the gap."""
    x = rows.where(F.col("value") > threshold).withWatermark("ts", lateness)
    gap = F.session_window("ts", f"{gap_seconds} seconds").alias("w")
    out = x.groupBy(gap, "session", "signal").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.max("value").alias("peak"), F.count("*").alias("n"))
    return out.select("session", "signal", "start", "end", "peak", "n")


def crossings(rows: DataFrame, threshold: float) -> DataFrame:
    """(session, signal, ts, row_id, value) of rows above a threshold whose row before was at or below it. The value before
    is kept per series between batches; within one, rows are ordered by time. A missing value forgets it."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(key, frames, state: GroupState):
        # arrays, and no frame without a crossing: frames for each of very many series are most of the time
        frames = list(frames)
        rows_ = frames[0] if len(frames) == 1 else pd.concat(frames)
        at = rows_["ts"].to_numpy("datetime64[us]").astype("int64")
        at[at == np.iinfo(np.int64).min] = np.iinfo(np.int64).max  # no time comes last
        order = np.lexsort((rows_["row_id"].to_numpy(), at))
        values = rows_["value"].to_numpy("float64")[order]
        before = state.get[0] if state.exists else None
        prior = np.append(np.nan if before is None else before, values[:-1])
        state.update((None if np.isnan(values[-1]) else float(values[-1]),))
        hits = order[(prior <= threshold) & (values > threshold)]
        if len(hits):
            hit = rows_.iloc[hits]
            yield pd.DataFrame({"session": [key[0]] * len(hit), "signal": [key[1]] * len(hit), "ts": hit["ts"], "row_id": hit["row_id"], "value": hit["value"]})

    out = f"session {kinds['session']}, signal string, ts {kinds['ts']}, row_id long, value double"
    return rows.groupBy("session", "signal").applyInPandasWithState(run, out, "before double", "append", GroupStateTimeout.NoTimeout)


def ordered_crossings(rows: DataFrame, threshold: float, lateness: str, forget_seconds: float) -> DataFrame:
    """(session, signal, ts, row_id, value) of rows above a threshold whose row before, in order of (ts, row_id) and at most
    ``forget_seconds`` older, was at or below it. A missing value forgets the one before.

    Rows wait in the state of their series until the watermark has passed them, so those that come out of order within
    ``lateness`` are put in order before anything is decided; ones that the watermark has passed are left out. A timer decides rows
    without waiting for new ones of the series, and ends the state when a next row would be too far from the last. So the
    rows written don't depend on how rows in time came in batches, and the state holds the rows of the last
    ``lateness`` and the series seen within ``forget_seconds``. Rows without a time, or with one before 1970, are left out.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    forget_us = int(forget_seconds * 1_000_000)

    def run(key, frames, state: GroupState):
        last_us, last, waiting = (state.get[0], state.get[1], list(zip(*state.get[2:]))) if state.exists else (None, None, [])
        passed = state.getCurrentWatermarkMs()
        for frame in frames:
            at = frame["ts"].to_numpy("datetime64[us]").astype("int64").tolist()
            new = zip(at, frame["row_id"].tolist(), [None if v != v else v for v in frame["value"].to_numpy("float64").tolist()])
            waiting += [r for r in new if r[0] > passed * 1000]  # the source's own filter is a batch behind
        waiting.sort(key=lambda r: r[:2])
        hits = []
        while waiting and waiting[0][0] <= passed * 1000:
            us, row_id, value = waiting.pop(0)
            if value is not None and last is not None and us - last_us <= forget_us and last <= threshold < value:
                hits.append((key[0], key[1], pd.Timestamp(us, unit="us", tz=zone), row_id, value))
            last_us, last = us, value
        if waiting:
            timer = waiting[0][0] // 1000 + 1
        else:
            timer = (last_us + forget_us) // 1000 + 1
        if not waiting and timer <= passed:
            state.remove()
        else:
            state.update((last_us, last, *([list(c) for c in zip(*waiting)] or [[], [], []])))
            state.setTimeoutTimestamp(max(timer, passed + 1))
        if hits:  # frames without rows for very many series would be much of the time
            yield pd.DataFrame(hits, columns=["session", "signal", "ts", "row_id", "value"]).astype({"ts": f"datetime64[us, {zone}]" if zone else "datetime64[us]"})

    zone = "UTC" if kinds["ts"] == "timestamp" else None
    out = f"session {kinds['session']}, signal string, ts {kinds['ts']}, row_id long, value double"
    state = "last_us long, last double, us array<long>, ids array<long>, waiting array<double>"
    timed = rows.select("session", "signal", "ts", F.col("row_id").cast("long").alias("row_id"), F.col("value").cast("double").alias("value")).where("ts IS NOT NULL")
    return timed.withWatermark("ts", lateness).groupBy("session", "signal").applyInPandasWithState(run, out, state, "append", GroupStateTimeout.EventTimeTimeout)


def without_repeats(rows: DataFrame, keys: list[str], lateness: str) -> DataFrame:
    """Rows whose keys did not come before within the watermark."""
    return rows.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys)


def replayed(log: DataFrame, session: str = "session", at: str = "ts", tie: str = "row_id") -> DataFrame:
    """An append-only log in the order in which each session wrote it."""
    return log.repartition(session).sortWithinPartitions(session, at, tie)


def loaded_files(spark: SparkSession, path: str, out: str, session: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Log files that arrive in a folder, read by the batch reader as they come. Returns the long rows, and per file
    (session_id, n_lines, n_rows): data lines that are not among the rows were skipped as malformed. ``session`` names a file's
    session, by default the file's name without its extension."""
    files = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    files = files.select((name if session is None else session).alias("session_id"), F.col("value").alias("body"))

    def take(batch: DataFrame, number: int) -> None:
        # a batch that is run again replaces what it wrote
        logs.rows(batch).write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
        lines = F.size(F.filter(F.split("body", "\r?\n"), lambda x: (F.trim(x) != "") & ~x.startswith("#"))) - 1
        batch.select("session_id", lines.alias("n_lines")).write.mode("overwrite").parquet(f"{out}/files/batch={number}")

    query = files.writeStream.foreachBatch(take).option("checkpointLocation", f"{out}/_checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{out}/rows").drop("batch")
    counts = rows.groupBy("session_id").agg(F.countDistinct("row_id").alias("n_rows"))
    return rows, spark.read.parquet(f"{out}/files").drop("batch").join(counts, "session_id", "left").na.fill(0, ["n_rows"])
