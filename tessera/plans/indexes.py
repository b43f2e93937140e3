"""Queries of layout streams, stored indexes, goldens and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import indexing
from tessera.registry import query, rounded
from tessera.sources import manuals as sources
from tessera.sources.tables import table


@query("""
WITH i AS (SELECT l_orderkey AS doc_id, l_linenumber AS page, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS nth FROM lineitem),
p AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY page) AS pg FROM i), f AS (SELECT * FROM p WHERE l_partkey % 5 > 0)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, nth) - 1 AS idx, pg AS page, CASE l_partkey % 5 WHEN 1 THEN 'title_candidate' WHEN 2 THEN 'table' ELSE 'para' END AS kind, 'part ' || l_partkey::VARCHAR AS text FROM f""")
def layout_items(spark, sf_dir):
    """Layouts made of orders, with a page for each line number."""
    x = table(spark, sf_dir, "lineitem")
    k = F.col("l_partkey") % 5
    kind = F.when(k == 0, "page_number").when(k == 1, "title").when(k == 2, "table").when(k == 3, "odd").otherwise("text")
    item = F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", F.struct(kind.alias("type"), F.concat(F.lit(" part "), F.col("l_partkey").cast("string")).alias("content")).alias("i"))
    pages = x.groupBy(F.col("l_orderkey").alias("doc_id"), "l_linenumber").agg(F.array_sort(F.collect_list(item)).alias("r"))
    docs = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.transform("r", lambda r: r["i"]).alias("items")))).alias("p"))
    layouts = docs.select("doc_id", F.to_json(F.transform("p", lambda p: p["items"])).alias("layout"))
    return sources.stream_items(layouts).select("doc_id", "idx", "page", "kind", "text")


@query("""
SELECT l_orderkey AS doc_id, l_linenumber AS page, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN l_orderkey % 20 AND l_orderkey % 20 + 20 AND l_discount BETWEEN 0.02 AND 0.07 GROUP BY 1, 2""")
def lines_in_regions(spark, sf_dir):
    """S16."""
    x = table(spark, sf_dir, "lineitem")
    lines = x.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.lit("").alias("line"))
    k = F.col("doc_id") % 20
    regions = lines.select("doc_id", "page").distinct().withColumns({"region": F.lit(1), "x0": k, "y0": F.lit(0.02), "x1": k + 20, "y1": F.lit(0.07)})
    return sources.region_lines(lines, regions).groupBy("doc_id", "page").agg(F.count("*").alias("n"))


@query("""
SELECT CASE WHEN c_custkey % 2 = 0 THEN 'v2/locked/a.jsonl' ELSE 'v2/candidates/b.jsonl' END AS path, CASE WHEN c_custkey % 2 = 0 THEN 'locked' ELSE 'candidate' END AS tier, c_custkey AS id FROM customer WHERE c_custkey % 7 > 1""")
def golden_lines(spark, sf_dir):
    """Two files of entries, one line in seven blank and one malformed."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    line = F.when(k % 7 == 0, " ").when(k % 7 == 1, "{broken").otherwise(F.concat(F.lit('{"id": '), k.cast("string"), F.lit("}")))
    path = F.when(k % 2 == 0, "v2/locked/a.jsonl").otherwise("v2/candidates/b.jsonl")
    files = c.groupBy(path.alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("l")))), lambda r: r["l"]), "\n").alias("body"))
    return sources.goldens(files).select("path", "tier", F.get_json_object("entry", "$.id").cast("long").alias("id"))


@query("SELECT c_mktsegment AS lane, count(*) AS n, count(*) FILTER (c_custkey % 3 > 0) AS graded, round(avg(CASE WHEN c_custkey % 3 > 0 THEN (c_custkey % 10) / 10 END), 6) AS mean FROM customer GROUP BY 1")
def report_scores(spark, sf_dir):
    """S21."""
    k = F.col("c_custkey")
    grade = F.when(k % 3 > 0, F.struct(((k % 10) / 10).alias("overall")))
    record = F.struct(F.struct(k.cast("string").alias("id"), F.col("c_mktsegment").alias("lane")).alias("entry"), grade.alias("grade"))
    reports = table(spark, sf_dir, "customer").groupBy((k % 4).cast("string").alias("report")).agg(F.to_json(F.struct(F.collect_list(record).alias("records"))).alias("body"))
    return rounded(sources.report_records(reports).groupBy("lane").agg(F.count("*").alias("n"), F.count("score").alias("graded"), F.avg("score").alias("mean")), "mean")


@query("""
SELECT c_custkey::VARCHAR AS manual_id, 'MWS-' || (c_custkey % 3)::VARCHAR AS vehicle_model, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_custkey::VARCHAR END AS title, 2 AS n_headings FROM customer WHERE c_custkey % 3 IN (1, 2)""")
def manual_list(spark, sf_dir):
    """Manuals of one model and its alias."""
    from tessera.functions import texts as X

    k = F.col("c_custkey")
    head = X.frontmatter({"vehicle_model": F.concat(F.lit("MWS-"), (k % 3).cast("string")), "title": F.when(k % 2 == 0, F.col("c_name"))})
    m = table(spark, sf_dir, "customer").select(k.cast("string").alias("manual_id"), F.concat(head, F.lit("# One\ntext\n## Two\n#no")).alias("text"))
    return sources.listed_manuals(m, "mws 1", {"mws 1": "MWS2"})


@query("""
WITH b AS (SELECT user_id AS session_id, event_id // 50 AS row_id, event_type AS signal, event_id, value FROM events), d AS (SELECT session_id, row_id, signal, arg_max(value, event_id) AS v, max(event_id) AS e FROM b GROUP BY 1, 2, 3)
SELECT session_id, row_id, string_agg(signal, ',' ORDER BY signal) FILTER (signal <> 'error' AND v IS NOT NULL) AS supported, 'P0' || (100 + max(e) FILTER (signal = 'error') % 9)::VARCHAR AS codes FROM d GROUP BY 1, 2""")
def log_snapshots(spark, sf_dir):
    """Rows of fifty events."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.expr("event_id div 50").alias("row_id"), F.col("event_type").alias("signal"), "event_id", "value")
    d = e.groupBy("session_id", "row_id", "signal").agg(F.max_by("value", "event_id").alias("value"), F.max("event_id").alias("e"))
    raw = F.concat(F.lit("[('p0"), (100 + F.col("e") % 9).cast("string"), F.lit("','x')]"))
    long = d.select("session_id", "row_id", F.when(F.col("signal") == "error", "GET_DTC").otherwise(F.col("signal")).alias("signal"), F.when(F.col("signal") != "error", F.col("value")).alias("value"), raw.alias("raw"))
    out = sources.snapshots(long.withColumn("raw", F.when(F.col("signal") == "GET_DTC", F.upper("raw")).otherwise("1")))
    return out.select("session_id", "row_id", F.nullif(F.array_join("supported", ","), F.lit("")).alias("supported"), F.nullif(F.array_join("codes", ","), F.lit("")).alias("codes"))


@query()
def unique_node_ids(spark, sf_dir):
    """Ids that may collide with natural ones; a test folds them one by one."""
    x = table(spark, sf_dir, "lineitem")
    base = F.when(F.col("l_partkey") % 3 == 0, "a").when(F.col("l_partkey") % 3 == 1, "a-2").otherwise("b")
    nodes = x.select((F.col("l_orderkey") % 500).cast("string").alias("manual_id"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("nth"), base.alias("base"))
    return indexing.unique_ids(nodes).groupBy("manual_id").agg(F.count("*").alias("n"), F.countDistinct("node_id").alias("n_ids"), F.md5(F.array_join(F.array_sort(F.collect_list("node_id")), ",")).alias("ids_md5"))


_NODES = """n AS (SELECT (l_orderkey % 40)::VARCHAR AS manual_id, l_orderkey AS s, lead(l_orderkey) OVER (PARTITION BY l_orderkey % 40 ORDER BY l_orderkey) AS f FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey // 40 % 4 = 0)),
nodes AS (SELECT manual_id, 'n' || s::VARCHAR AS node_id, CASE WHEN s // 160 % 2 = 0 THEN 'procedure' ELSE 'table' END AS node_type, s AS span_start, coalesce(f, s + 1) AS span_end FROM n),
items AS (SELECT (l_orderkey % 40)::VARCHAR AS manual_id, l_orderkey AS idx, 'see P0' || (100 + l_partkey % 30)::VARCHAR AS text, CASE WHEN l_linenumber = 7 THEN 'noise' ELSE 'para' END AS kind, 'P0' || (100 + l_partkey % 30)::VARCHAR AS code FROM lineitem)"""


def _index(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    key = (F.col("l_orderkey") % 40).cast("string").alias("manual_id")
    starts = x.where("l_orderkey div 40 % 4 = 0").select(key, F.col("l_orderkey").alias("span_start")).distinct()
    end = F.coalesce(F.lead("span_start").over(Window.partitionBy("manual_id").orderBy("span_start")), F.col("span_start") + 1)
    kind = F.when(F.expr("span_start div 160 % 2") == 0, "procedure").otherwise("table")
    nodes = starts.select("manual_id", F.concat(F.lit("n"), F.col("span_start").cast("string")).alias("node_id"), kind.alias("node_type"), "span_start", end.alias("span_end"))
    text = F.concat(F.lit("see P0"), (100 + F.col("l_partkey") % 30).cast("string"))
    return nodes, x.select(key, F.col("l_orderkey").alias("idx"), text.alias("text"), F.when(F.col("l_linenumber") == 7, "noise").otherwise("para").alias("kind"))


_CARDS = """m AS (SELECT i.manual_id, i.code, n.node_type, n.node_id, count(*) AS n FROM items AS i JOIN nodes AS n ON n.manual_id = i.manual_id AND i.idx >= span_start AND i.idx < span_end GROUP BY ALL),
cards AS (SELECT t.manual_id, t.code, n_rows, p.node_id AS isolate_ref, d.node_id AS detect_ref FROM (SELECT manual_id, code, count(*) AS n_rows FROM items GROUP BY 1, 2) AS t
  LEFT JOIN (SELECT manual_id, code, arg_min(node_id, (-n, node_id)) AS node_id FROM m WHERE node_type = 'procedure' GROUP BY 1, 2) AS p USING (manual_id, code)
  LEFT JOIN (SELECT manual_id, code, arg_min(node_id, (-n, node_id)) AS node_id FROM m WHERE node_type = 'table' GROUP BY 1, 2) AS d USING (manual_id, code))"""


@query(f"WITH {_NODES}, {_CARDS} SELECT * FROM cards")
def code_cards(spark, sf_dir):
    """M8."""
    nodes, items = _index(spark, sf_dir)
    return indexing.code_cards(nodes, items)


@query(f"""
WITH {_NODES}, {_CARDS}, c2 AS (SELECT manual_id, code, CASE WHEN code = 'P0101' THEN 'gone' ELSE isolate_ref END AS isolate_ref, detect_ref FROM cards WHERE code <> 'P0100'),
e AS (SELECT manual_id, min(idx) AS lo, max(idx) + 1 AS hi, count(*) AS n, count(*) FILTER (kind = 'noise') AS z FROM items GROUP BY 1),
l AS (SELECT nodes.*, lo, hi, CASE WHEN span_start <> coalesce(lag(span_end) OVER w, lo) THEN 1 ELSE 0 END + CASE WHEN lead(span_start) OVER w IS NULL AND span_end <> hi THEN 1 ELSE 0 END AS bad FROM nodes JOIN e USING (manual_id) WINDOW w AS (PARTITION BY manual_id ORDER BY span_start, span_end)),
g AS (SELECT manual_id, 'tiling' AS gate, sum(bad)::BIGINT AS n_bad FROM l GROUP BY 1 UNION ALL SELECT DISTINCT manual_id, 'shells', 0 FROM nodes UNION ALL SELECT manual_id, 'vocabulary', count(*) FILTER (node_type = 'table') FROM nodes GROUP BY 1
  UNION ALL SELECT manual_id, 'titles', count(*) FILTER (length(node_id) < 4) FROM nodes GROUP BY 1
  UNION ALL SELECT n.manual_id, 'codes', (SELECT count(DISTINCT code) FROM items AS i WHERE i.manual_id = n.manual_id AND code = 'P0100') FROM (SELECT DISTINCT manual_id FROM nodes) AS n
  UNION ALL SELECT n.manual_id, 'refs', (SELECT count(*) FROM c2 WHERE c2.manual_id = n.manual_id AND code = 'P0101') FROM (SELECT DISTINCT manual_id FROM nodes) AS n
  UNION ALL SELECT manual_id, 'noise', CASE WHEN z > 0.1 * n THEN z ELSE 0 END FROM e WHERE manual_id IN (SELECT manual_id FROM nodes))
SELECT manual_id, gate, n_bad, n_bad = 0 AS passes FROM g""")
def index_gates(spark, sf_dir):
    """An index with faults of each kind."""
    nodes, items = _index(spark, sf_dir)
    cards = indexing.code_cards(nodes, items).where("code <> 'P0100'").withColumn("isolate_ref", F.when(F.col("code") == "P0101", "gone").otherwise(F.col("isolate_ref")))
    title = F.when(F.length("node_id") < 4, "x").otherwise("Title of it")
    nodes = nodes.withColumn("title", title).withColumn("subsystem", F.when(F.col("node_type") == "table", "odd").otherwise("engine")).withColumn("is_leaf", F.lit(True))
    return indexing.gates(nodes, items, cards, ["engine", "brakes"], 0.1)


@query("""
WITH i AS (SELECT doc_id, (doc_id % 3 + nth // 4)::INT AS page, nth AS idx, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS nth FROM documents)),
own AS (SELECT * FROM i WHERE idx % 3 > 0), k AS (SELECT *, regexp_replace(lower(line), '[^一-鿿㐀-䶿a-z0-9]+', '', 'g') AS bare FROM i),
p AS (SELECT doc_id, page, string_agg(regexp_replace(lower(line), '[^一-鿿㐀-䶿a-z0-9]+', '', 'g'), '' ORDER BY idx) AS all_ FROM own GROUP BY 1, 2),
u AS (SELECT doc_id, page, 0 AS late, idx, line FROM own WHERE trim(line, ' ') <> '' UNION ALL SELECT k.doc_id, k.page, 1, idx, line FROM k LEFT JOIN p USING (doc_id, page) WHERE length(bare) >= 4 AND NOT coalesce(contains(all_, bare), false))
SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY page, late, idx) - 1 AS place, md5(line) AS line_md5, late = 1 AS backfilled FROM u""")
def composed_content(spark, sf_dir):
    """Two lines in three as items, all as the baseline."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("nth", "line"))
    x = d.withColumn("page", (F.col("doc_id") % 3 + F.expr("nth div 4")).cast("int"))
    items = x.where("nth % 3 > 0").select("doc_id", "page", F.col("nth").alias("idx"), F.col("line").alias("text"))
    return indexing.composed(items, x).select("doc_id", "page", "place", F.md5("line").alias("line_md5"), "backfilled")


@query("""
WITH o AS (SELECT s_suppkey AS manual_id, unnest(['brake-pads', 'Brake_Oil', 'chain-2', 'tyre', 'lost', 'none']) AS slug FROM supplier), q AS (SELECT *, CASE slug WHEN 'lost' THEN 'turn  the key' ELSE '' END AS quote FROM o)
SELECT manual_id, slug, CASE slug WHEN 'brake-pads' THEN 'brake-pads' WHEN 'Brake_Oil' THEN 'brake-oil' WHEN 'chain-2' THEN 'chain-3' WHEN 'tyre' THEN 'front-tyre' WHEN 'lost' THEN 'start' END AS new_slug,
  CASE slug WHEN 'brake-pads' THEN 0 WHEN 'Brake_Oil' THEN 1 WHEN 'chain-2' THEN 2 WHEN 'tyre' THEN 3 WHEN 'lost' THEN 4 END AS how FROM q""")
def migrated_slugs(spark, sf_dir):
    """M12."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("manual_id"))
    old = s.withColumn("slug", F.explode(F.array(*[F.lit(x) for x in ("brake-pads", "Brake_Oil", "chain-2", "tyre", "lost", "none")]))).withColumn("quote", F.when(F.col("slug") == "lost", "turn  the key").otherwise(""))
    texts = {"brake-pads": "a", "brake-oil": "b", "chain-3": "c", "front-tyre": "d", "front-tyres-all": "e", "start": "First Turn the\nkey."}
    new = s.withColumn("r", F.explode(F.array(*[F.struct(F.lit(k).alias("slug"), F.lit(v).alias("text")) for k, v in texts.items()]))).select("manual_id", "r.*")
    return indexing.migrated_slugs(old, new)


@query()
def built_index(spark, sf_dir):
    """Indexes of documents as layouts, with their gates; a test builds one by hand."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select((F.col("doc_id") % 50).cast("string").alias("manual_id"), "doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    n = F.length("line")
    kind = F.when(F.col("p") == 0, "page_header").when((n > 1) & (n <= 60), "title_candidate").otherwise("para")
    text = F.when(F.col("p") == 0, F.concat(F.lit("Chapter "), F.expr("cast(doc_id div 200 as string)"))).otherwise(F.col("line"))
    rows = d.select("manual_id", F.struct("doc_id", "p").alias("at"), F.col("doc_id").alias("page"), kind.alias("kind"), text.alias("text"), F.lit("").alias("html"))
    idx = F.row_number().over(Window.partitionBy("manual_id").orderBy("at")) - 1
    items = rows.select("manual_id", idx.alias("idx"), "page", "kind", "text", "html")
    nodes, _, found = indexing.build_index(items, F.when(F.length("title") % 2 == 0, "engine").otherwise("brakes"), ["engine", "brakes"])
    n_nodes = nodes.groupBy("manual_id").agg(F.count("*").alias("n_nodes"), F.sum(F.size("aliases")).alias("n_aliases"))
    return found.join(n_nodes, "manual_id").select("manual_id", "gate", "n_bad", "passes", "n_nodes", "n_aliases")
