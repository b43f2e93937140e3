"""Queries of running values over ranges, nested spans, and nested trees of documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import scans, trees
from tessera.registry import query, rounded
from tessera.sources.tables import signals, table


@query("""
SELECT event_id AS row_id, round(coalesce(sum(value) OVER (w ROWS UNBOUNDED PRECEDING), 0), 6) + 0.0 AS total, last_value(value IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS latest,
  lag(event_id) OVER w AS before FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""")
def running_values(spark, sf_dir):
    """Sums, last and previous values of series as long as an event type, cut into days."""
    x = signals(spark, sf_dir)
    x = scans.running(x, ["signal"], "us", ["row_id"], scans.DAY_US, {"total": F.col("value")}, {"latest": F.col("value")}, {"before": F.col("row_id")})
    return rounded(x.select("row_id", "total", "latest", "before"), "total")


@query("""
WITH s AS (SELECT DISTINCT o_custkey % 5 AS k, o_orderkey // w * w AS lo, o_orderkey // w * w + w AS hi FROM (SELECT *, 1 << (2 * (o_custkey % 6))::INT AS w FROM orders)),
p AS (SELECT l_suppkey % 5 AS k, l_orderkey AS "at", count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT p.k, p."at", max(n) AS n, arg_min(lo, hi - lo) AS lo, min(hi - lo) AS size FROM p LEFT JOIN s ON p.k = s.k AND p."at" >= lo AND p."at" < hi GROUP BY 1, 2""")
def deepest_spans(spark, sf_dir):
    """The deepest of nested ranges of orders around each order's lines."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    tasks = scans.tasks_for(spark, 2 * orders.count() + lines.count())
    o = orders.select((F.col("o_custkey") % 5).alias("k"), "o_orderkey", F.expr("shiftleft(1, cast(2 * (o_custkey % 6) AS int))").cast("long").alias("w"))
    start = F.floor(F.col("o_orderkey") / F.col("w")) * F.col("w")
    spans = o.select("k", start.alias("start"), (start + F.col("w")).alias("end")).repartition(tasks, "k", "start", "end").distinct().withColumn("span_id", F.struct("start", "end"))
    points = lines.select((F.col("l_suppkey") % 5).alias("k"), F.col("l_orderkey").alias("at")).repartition(tasks, "k", "at").groupBy("k", "at").agg(F.count("*").alias("n"))
    found = scans.deepest_span(points, spans, ["k"], 4096, tasks)
    return found.select("k", "at", "n", F.col("span_id.start").alias("lo"), (F.col("span_id.end") - F.col("span_id.start")).alias("size"))


WORDS = trees.Vocabulary(
    {"general": ("規格",), "engine": ("引擎", "Engine"), "ignition": ("點火系統",), "brakes": ("煞車",)},
    {"operation": ("的調整",), "inspection": ("的檢查",), "fault_isolation": ("故障代碼編號",), "troubleshooting_tree": ("無法起動",), "description": ()},
    ("引擎", "點火系統", "煞車系統"),
)
_HEADERS = ("引擎系統", "故障排除詳細", "YAMAHA", "Engine overhaul")
_TITLES = ("引擎", "點火系統", "煞車系統", "引擎無法起動", "火星塞", "Cold engine", "注 意", "3. 拆下", "• bullet")
_TASKS = ("油門的調整", "汽門間隙的檢查", "3. 油門的調整")


def document_items(spark, sf_dir):
    """Items of fifty manuals: each document a page, its first line the running header, short lines titles by their checksum, a line in
    eleven a task, one in thirteen the block of a trouble code, all others their own text."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select((F.col("doc_id") % 50).cast("string").alias("manual_id"), "doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    h = F.crc32("line")
    of = lambda values, k: F.get(F.array(*map(F.lit, values)), (k % len(values)).cast("int"))
    kind = F.when(F.col("p") == 0, "page_header").when(h % 5 == 0, "title_candidate").when(h % 13 == 1, "table").when(h % 17 == 2, "image").otherwise("para")
    code = F.concat(F.lit("故障代碼編號 P0"), (100 + F.expr("crc32(line) div 221") % 40).cast("string"))
    text = F.when(kind == "page_header", of(_HEADERS, h)).when(kind == "title_candidate", of(_TITLES, F.expr("crc32(line) div 5"))).when(kind == "table", "").when(h % 11 == 3, of(_TASKS, F.expr("crc32(line) div 11"))).otherwise(F.col("line"))
    html = F.when((kind == "table") & (h % 3 == 0), F.concat(F.lit("<tr>"), code, F.lit("</tr>"))).when((kind == "table") & (h % 3 == 1), "<tr>鎖緊扭力</tr>").otherwise("")
    x = d.select("manual_id", "doc_id", "p", kind.alias("kind"), text.alias("text"), html.alias("html"))
    idx = F.row_number().over(Window.partitionBy("manual_id").orderBy("doc_id", "p")) - 1
    return x.select("manual_id", idx.alias("idx"), F.col("doc_id").alias("page"), "kind", "text", "html")


@query()
def nested_tree(spark, sf_dir):
    """Trees of three levels, equal to those by hand in a test."""
    out = trees.nested_tree(document_items(spark, sf_dir), WORDS)
    return out.withColumn("aliases", F.array_join(F.array_sort("aliases"), "|"))


@query()
def nested_cards(spark, sf_dir):
    """Cards that point into nested trees, equal to those by hand in a test."""
    items = document_items(spark, sf_dir)
    return trees.fault_cards(trees.nested_tree(items, WORDS), items)
