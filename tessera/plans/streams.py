"""Queries of the streaming forms: the events table as a stream, drained, with what has been written so far."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.registry import query, rounded
from tessera.sources.tables import table
from tessera.streaming import live

_US = "epoch_us({0})"


def stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    # a pattern, as a streaming source takes a folder or a pattern, and the table may be one file
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    return rows.select(F.col("user_id").alias("session"), F.col("event_type").alias("signal"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("row_id"), "value")


def _us(name):
    return F.unix_micros(F.col(name).cast("timestamp"))


@query("""
WITH w AS (SELECT user_id AS session, event_type AS signal, epoch_us(ts) // 21600000000 * 21600000000 AS start_us, avg(value) AS value, count(*) AS n FROM events WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY ALL)
SELECT session, signal, start_us, round(value, 6) AS value, n FROM w WHERE start_us + 21600000000 <= (SELECT max(epoch_us(ts)) // 1000 * 1000 FROM events WHERE value IS NOT NULL AND NOT isnan(value)) - 3600000000""")
def stream_grid(spark, sf_dir):
    """Six-hour means that are closed, an hour after the last row."""
    out = live.drained(live.gridded(stream(spark, sf_dir), 21_600, "1 hour"), live.folder(spark, "grid"))
    return rounded(out.select("session", "signal", _us("start").alias("start_us"), "value", "n"), "value")


@query("""
WITH h AS (SELECT user_id AS session, event_type AS signal, epoch_us(ts) AS us, event_id, value FROM events WHERE value > 40),
g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY session, signal ORDER BY us, event_id) < 43200000000 THEN 0 ELSE 1 END AS new FROM h),
r AS (SELECT *, sum(new) OVER (PARTITION BY session, signal ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT session, signal, min(us) AS start_us, max(us) AS end_us, max(value) AS peak, count(*) AS n FROM r GROUP BY session, signal, run
HAVING max(us) + 43200000000 <= (SELECT max(us) // 1000 * 1000 FROM h) - 3600000000""")
def stream_events(spark, sf_dir):
    """Events by gaps of half a day that have passed."""
    out = live.drained(live.events_above(stream(spark, sf_dir), 40.0, 43_200, "1 hour"), live.folder(spark, "events"))
    return out.select("session", "signal", _us("start").alias("start_us"), _us("end").alias("end_us"), "peak", "n")


@query("""
WITH o AS (SELECT *, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS b FROM events)
SELECT user_id AS session, event_type AS signal, event_id AS row_id, value FROM o WHERE b <= 30 AND value > 30""")
def stream_crossings(spark, sf_dir):
    """X7."""
    out = live.drained(live.crossings(stream(spark, sf_dir), 30.0), live.folder(spark, "crossings"))
    return out.select("session", "signal", "row_id", "value")


@query("SELECT user_id AS session, event_type AS signal, min(epoch_us(ts)) > 0 AS dated FROM events GROUP BY 1, 2")
def stream_first_seen(spark, sf_dir):
    """Series, each once however often it comes within the watermark."""
    out = live.drained(live.without_repeats(stream(spark, sf_dir), ["session", "signal"], "3650 days"), live.folder(spark, "first"))
    return out.select("session", "signal", (_us("ts") > 0).alias("dated"))


@query("""
SELECT session, row_id, lag(row_id) OVER (PARTITION BY session ORDER BY us, row_id) AS before FROM (SELECT user_id AS session, event_id AS row_id, epoch_us(ts) AS us FROM events)""")
def stream_replay(spark, sf_dir):
    """The log appended by a stream, and for each entry the one before it in its session."""
    from pyspark.sql import Window

    log = live.drained(stream(spark, sf_dir), live.folder(spark, "log"))
    return live.replayed(log).select("session", "row_id", F.lag("row_id").over(Window.partitionBy("session").orderBy("ts", "row_id")).alias("before"))


@query("""
WITH r AS (SELECT (event_id // 1000)::VARCHAR AS session_id, event_id % 9 = 0 AS bad FROM events)
SELECT session_id, count(*)::INT AS n_lines, count(*) FILTER (NOT bad) AS n_rows FROM r GROUP BY 1""")
def stream_files(spark, sf_dir):
    """Files of a thousand events, each ninth line without a time."""
    e = table(spark, sf_dir, "events")
    at = F.when(F.col("event_id") % 9 == 0, "no time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    line = F.concat_ws(",", at, F.coalesce(F.col("value").cast("string"), F.lit("N/A")))
    x = e.select(F.expr("cast(event_id div 1000 as string)").alias("s"), F.struct("event_id", line.alias("line")).alias("l")).groupBy("s").agg(
        F.concat(F.lit("Timestamp,VALUE\n"), F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda l: l["line"]), "\n")).alias("value")
    )
    landing, out = live.folder(spark, "landing"), live.folder(spark, "loaded")
    x.write.partitionBy("s").text(landing)
    _, files = live.loaded_files(spark, landing, out, F.regexp_extract(F.col("_metadata.file_path"), "/s=([^/]*)/", 1))
    return files.select("session_id", F.col("n_lines").cast("int").alias("n_lines"), "n_rows")


@query("""
WITH s AS (SELECT *, epoch_us(ts) AS us, CASE WHEN isnan(value) THEN NULL ELSE value END AS v FROM events),
o AS (SELECT *, lag(v) OVER w AS b, us - lag(us) OVER w AS gap FROM s WHERE us <= (SELECT max(epoch_us(ts)) // 1000 * 1000 FROM events) - 3600000000 WINDOW w AS (PARTITION BY user_id, event_type ORDER BY us, event_id))
SELECT user_id AS session, event_type AS signal, event_id AS row_id, value FROM o WHERE b <= 30 AND v > 30 AND gap <= 259200000000""")
def stream_ordered_crossings(spark, sf_dir):
    """Crossings of 30 within three days, decided when the watermark has passed; the last hour stays undecided."""
    out = live.drained(live.ordered_crossings(stream(spark, sf_dir), 30.0, "1 hour", 3 * 86_400), live.folder(spark, "ordered"))
    return out.select("session", "signal", "row_id", "value")
