"""Crossings of a stream whose rows come out of order, against the rows in order."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tessera.streaming import live

START = datetime.datetime(2024, 1, 1)
SCHEMA = "session int, signal string, ts timestamp, row_id long, value double"


def _plain(rows, threshold, forget):
    out, last = set(), {}
    for session, signal, ts, row_id, value in sorted((r for r in rows if r[2]), key=lambda r: (r[0], r[1], r[2], r[3])):
        before = last.get((session, signal))
        if before and value is not None and value == value and before[1] is not None and before[1] <= threshold < value and (ts - before[0]).total_seconds() <= forget:
            out.add((session, signal, row_id))
        last[session, signal] = ts, None if value is None or value != value else value
    return out


def _run(spark, tmp_path, files, forget, lateness="60 seconds"):
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/f={k:03d}")
    stream = spark.readStream.schema(SCHEMA + ", f int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").drop("f")
    out = live.ordered_crossings(stream, 5.0, lateness, forget)
    query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.schema(out.schema).parquet(f"{tmp_path}/out")
    return got, query.lastProgress["stateOperators"][0]["numRowsTotal"]


@pytest.mark.parametrize("forget", [20, 4000])
def test_rows_out_of_order_within_the_watermark(spark, tmp_path, forget):
    rng = random.Random(forget)
    at = lambda s: START + datetime.timedelta(seconds=s)
    rows = [(k % 3, "ab"[k % 2], at(rng.uniform(0, 600)), k, rng.choice([1.0, 5.0, 9.0, None, float("nan"), rng.uniform(0, 10)])) for k in range(500)]
    rows += [(0, "a", at(300), 1000 + k, float(k % 2 * 9)) for k in range(6)] + [(1, "a", None, 2000, 9.0)]
    # each comes up to 50 seconds late, in eight files by arrival; the last row closes all
    arrival = sorted(rows, key=lambda r: (r[2] or START).timestamp() + rng.uniform(0, 50))
    files = [arrival[k * 64 : k * 64 + 64] for k in range(8)]
    got, held = _run(spark, tmp_path, [*files, [(9, "z", at(100_000), 5000, 1.0)]], forget)
    assert {(r["session"], r["signal"], r["row_id"]) for r in got.collect()} == _plain(rows, 5.0, forget)
    assert held == 1  # the states of all series that ended are gone
    times = {r[3]: r[2] for r in rows}
    assert all(r["ts"] == times[r["row_id"]] for r in got.collect())


def test_rows_later_than_the_watermark_are_left_out(spark, tmp_path):
    at = lambda s: START + datetime.timedelta(seconds=s)
    files = [[(1, "a", at(0), 1, 1.0)], [(1, "a", at(500), 2, 9.0)], [(1, "a", at(10), 3, 9.0)], [(1, "a", at(700), 4, 1.0), (1, "a", at(701), 5, 8.0)], [(1, "a", at(2000), 6, 1.0)]]
    got, _ = _run(spark, tmp_path, files, 4000)
    assert {r["row_id"] for r in got.collect()} == {2, 5}


def test_a_stream_without_rows(spark, tmp_path):
    got, _ = _run(spark, tmp_path, [[(1, "a", None, 1, None)]], 10)
    assert got.count() == 0
