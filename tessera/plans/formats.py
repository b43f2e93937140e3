"""Queries that write logs in each format, read them back, and look up stored texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import evaluation, manuals, writers
from tessera.operators.tools import TOOLS
from tessera.registry import query
from tessera.sources import logs
from tessera.sources import manuals as sources
from tessera.sources.tables import signals, table
from tessera.streaming.live import folder


@query("""
WITH b AS (SELECT (event_id // 100)::VARCHAR AS session_id, event_id // 100 % 4 AS kind, row_number() OVER (PARTITION BY event_id // 100 ORDER BY event_id) - 1 AS row_id, date_trunc('second', ts) AS at_, round(value)::BIGINT AS rpm, user_id AS speed FROM events WHERE value IS NOT NULL)
SELECT session_id, CASE kind WHEN 0 THEN 'native_tsv' WHEN 1 THEN 'csvlog_obdwiz' WHEN 2 THEN 'obd_maxlog' ELSE 'yamaha_dual' END AS format, row_id, strftime(at_, '%Y-%m-%d %H:%M:%S') AS "at", signal,
  CASE WHEN signal = 'SPEED' AND kind = 1 THEN round(speed * 1.60934::DOUBLE, 2) WHEN signal = 'SPEED' THEN speed ELSE rpm END::DOUBLE AS value, 'bike ' || session_id AS vehicle_id
FROM b, (SELECT unnest(['RPM', 'SPEED']) AS signal)""")
def log_formats(spark, sf_dir):
    """Logs of four formats, with times in twelve hours, units and dropped columns."""
    e = table(spark, sf_dir, "events").where("value IS NOT NULL").withColumn("t", F.date_trunc("second", "ts")).withColumn("s", F.expr("event_id div 100"))
    rpm, speed = F.round("value").cast("long").cast("string"), F.col("user_id").cast("string")
    iso = F.date_format("t", "yyyy-MM-dd HH:mm:ss")
    twelve = F.concat(F.date_format("t", "MM/dd/yyyy hh:mm:ss"), F.lit(".1234 "), F.when(F.hour("t") < 12, "上午").otherwise("下午"))
    # a running number keeps neighbouring rows of the format that drops repeats apart
    nth = F.row_number().over(Window.partitionBy("s").orderBy("event_id")).cast("string")
    e = e.withColumn("nth", nth)
    k = F.col("s") % 4
    line = F.when(k == 0, F.concat_ws("\t", iso, rpm, speed, F.lit("[]"))).when(k == 1, F.concat_ws(",", twelve, speed, rpm, "nth")).when(k == 2, F.concat_ws(",", F.replace(iso, F.lit(" "), F.lit("T")), rpm, F.lit("9"), speed)).otherwise(
        F.concat_ws(",", F.concat(iso, F.lit(".5")), rpm, F.lit("7"), speed)
    )
    head = {
        0: "Data Log\n----\nTimestamp\tRPM\tSPEED\tGET_DTC\n----\n", 1: "Time,车速 (MPH),发动机转速 (RPM),燃油类型\n", 2: "Timestamp,RPM (rpm),DTC_COUNT,SPEED (km/h)\n", 3: "# Yamaha Dual\nTimestamp,A_KL_RPM,A_YAM_X,A_KL_SPEED\n",
    }
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "line"))), lambda r: r["line"]), "\n")
    x = e.withColumn("line", line).groupBy("s").agg(lines.alias("lines"))
    top = F.lit("")
    for kind, text in head.items():
        top = F.when(k == kind, text).otherwise(top)
    name = F.concat(F.lit("# vehicle_id: bike "), F.col("s").cast("string"), F.lit("\n"))
    files = x.select(F.col("s").cast("string").alias("session_id"), F.concat(name, top, "lines").alias("body"))
    out = logs.rows(files).where("signal IN ('RPM', 'SPEED')").join(logs.vehicle(files), "session_id")
    return out.select("session_id", "format", "row_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "signal", "value", "vehicle_id")


@query("""
SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE text IS NOT NULL""")
def stored_texts(spark, sf_dir):
    """Texts moved to files, and looked up again by the session's path."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    path = folder(spark, "texts")
    rows = writers.to_files(d.select("doc_id", "text"), "text", F.col("doc_id").cast("string"), path)
    back = spark.read.schema("file_path string, body string, shelf int").parquet(path).select("file_path", "body")
    sessions = rows.select(F.col("doc_id").alias("session_id"), "file_path")
    return sources.session_files(sessions, back).select(F.col("session_id").alias("doc_id"), F.md5("body").alias("text_md5"))


@query("""
WITH l AS (SELECT doc_id AS manual_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents WHERE text IS NOT NULL)
SELECT manual_id, k // 3 AS node, md5(string_agg(line, chr(10) ORDER BY k)) AS text_md5 FROM l GROUP BY 1, 2""")
def stored_nodes(spark, sf_dir):
    """Nodes of three lines each and their texts."""
    l = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("manual_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))  # noqa: E741
    nodes = l.select("manual_id", F.expr("line_no div 3").alias("node_id")).distinct().withColumns({"line_start": F.col("node_id") * 3, "line_end": F.col("node_id") * 3 + 3})
    return sources.node_texts(nodes, l).select("manual_id", F.col("node_id").alias("node"), F.md5("text").alias("text_md5"))


@query("""
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '### Part ' || p_partkey::VARCHAR WHEN 1 THEN '<span id="page-1-1"></span>' || p_partkey::VARCHAR || '. step:' ELSE 'Part ' || p_partkey::VARCHAR END AS line FROM part""")
def promoted_titles(spark, sf_dir):
    """F28."""
    k, n = F.col("p_partkey") % 3, F.col("p_partkey").cast("string")
    span = F.lit('<span id="page-1-1"></span>')
    line = F.when(k == 0, F.concat(span, F.lit(" "), span, F.lit("Part "), n)).when(k == 1, F.concat(span, n, F.lit(". step:"))).otherwise(F.concat(F.lit("Part "), n))
    return table(spark, sf_dir, "part").select("p_partkey", manuals.promoted(line).alias("line"))


@query("SELECT user_id AS session, event_type AS signal, count(value) AS n FROM events WHERE event_type IN ('view', 'error') AND NOT isnan(value) GROUP BY 1, 2")
def tool_calls(spark, sf_dir):
    """A tool called by name with checked arguments."""
    return TOOLS.call("get_signal_stats", signals(spark, sf_dir), signals=["view", "error"]).select("session", "signal", "n")


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN (o_orderkey % 7) / 7 ELSE 0 END AS section_recall, CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE (o_orderkey % 5) / 5 END::DOUBLE AS value_accuracy FROM orders""")
def metrics_by_lane(spark, sf_dir):
    """Orders that are open count as entries of the manuals' lane, the others as the signals' lane."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k, ((k % 7) / 7).alias("section_recall"), ((k % 5) / 5).alias("value_accuracy"), F.when(F.col("o_orderstatus") != "O", "event_finding").alias("question_type"))
    return evaluation.by_lane(rows.withColumn("signal_recall", F.lit(0.0))).select("o_orderkey", "section_recall", "value_accuracy")
