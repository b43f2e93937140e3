"""Queries of documents as manuals: trees, sections, search, chunks and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import manuals
from tessera.registry import query
from tessera.sources.tables import table

SLUG = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9\\x{{2E80}}-\\x{{9FFF}}\\x{{F900}}-\\x{{FAFF}}-]+', '-', 'g'), '^-+|-+$', '', 'g')"
SHORT = "CASE WHEN length({0}) <= 80 THEN {0} ELSE regexp_replace(left({0}, 80), '-[^-]*$', '') END"


def manual_lines(spark, sf_dir):
    """The documents' lines, short ones as headings: up to 20 characters of level 1, up to 45 of 2, up to 70 of 3."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    x = d.select(F.col("doc_id").alias("id"), F.posexplode(F.split("text", "\n")).alias("p", "line"))
    n = F.length("line")
    mark = F.when((n > 0) & (n <= 20), "# ").when((n > 20) & (n <= 45), "## ").when((n > 45) & (n <= 70), "### ").otherwise("")
    return x.select("id", (F.col("p") + 1).alias("line_no"), F.concat(mark, "line").alias("line"))


LINES = """l AS (
  SELECT id, line_no, CASE WHEN length(raw) BETWEEN 1 AND 20 THEN '# ' WHEN length(raw) BETWEEN 21 AND 45 THEN '## ' WHEN length(raw) BETWEEN 46 AND 70 THEN '### ' ELSE '' END || raw AS line
  FROM (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
), h0 AS (
  SELECT id, line_no, length(regexp_extract(line, '^#+')) AS level, trim(regexp_extract(line, '^#{1,6}\\s+(.+)$', 1)) AS title FROM l WHERE regexp_matches(line, '^#{1,6}\\s+.+$')
), h AS (SELECT * FROM h0 WHERE title <> '' AND length(title) <= 150 AND NOT regexp_matches(title, '^\\s*\\d+\\.\\s+\\S{1,40}:?\\s*$'))"""
SECTIONS = LINES + f""", e AS (SELECT id, max(line_no) + 1 AS eof FROM l GROUP BY 1),
b AS (SELECT h.*, {SHORT.format('z')} AS base FROM (SELECT *, {SLUG.format('title')} AS z FROM h) AS h),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY line_no) AS nth, row_number() OVER (PARTITION BY id, base ORDER BY line_no) AS again FROM b),
s AS (SELECT n.id, n.line_no, n.level, n.title, n.nth, CASE WHEN again = 1 THEN base ELSE base || '-' || again::VARCHAR END AS slug,
  (SELECT max(p.line_no) FROM n AS p WHERE p.id = n.id AND p.line_no < n.line_no AND p.level < n.level) AS parent_line,
  coalesce((SELECT min(p.line_no) FROM n AS p WHERE p.id = n.id AND p.line_no > n.line_no), eof) AS end_line,
  coalesce((SELECT min(p.line_no) FROM n AS p WHERE p.id = n.id AND p.line_no > n.line_no AND p.level <= n.level), eof) AS subtree_end FROM n JOIN e USING (id))"""


@query(f"WITH {SECTIONS} SELECT s.*, (SELECT count(*) FROM s AS p WHERE p.id = s.id AND p.line_no > s.line_no AND p.line_no < s.subtree_end) AS n_below FROM s")
def heading_tree(spark, sf_dir):
    """M1, W10, W12, W13, P15, F27 (the documents have no figures)."""
    return manuals.sections(manual_lines(spark, sf_dir))


@query(f"""WITH {SECTIONS} SELECT id, nth, repeat('  ', level - 1) || '- ' || title || ' [#' || slug || ']' AS entry,
  (SELECT count(*) FROM s AS p WHERE p.id = s.id AND p.line_no > s.line_no AND p.line_no < s.subtree_end) AS n_below FROM s WHERE level <= 2""")
def table_of_contents(spark, sf_dir):
    """M2."""
    return manuals.table_of_contents(manuals.sections(manual_lines(spark, sf_dir)), 2)


@query(f"""WITH {SECTIONS}, w AS (SELECT l.*, s.slug FROM l ASOF JOIN s ON l.id = s.id AND l.line_no >= s.line_no)
SELECT id, slug, md5(regexp_replace(string_agg(line, chr(10) ORDER BY line_no), '\\s+$', '')) AS text_md5 FROM w GROUP BY 1, 2""")
def section_texts(spark, sf_dir):
    """M3: sections without their subsections."""
    lines = manual_lines(spark, sf_dir)
    return manuals.section_texts(lines, manuals.sections(lines)).select("id", "slug", F.md5("text").alias("text_md5"))


@query(f"""WITH {SECTIONS}
SELECT s.id, slug, md5(regexp_replace(string_agg(line, chr(10) ORDER BY l.line_no), '\\s+$', '')) AS text_md5 FROM s JOIN l ON l.id = s.id AND l.line_no >= s.line_no AND l.line_no < subtree_end GROUP BY 1, 2""")
def section_subtrees(spark, sf_dir):
    """M3: sections with their subsections."""
    lines = manual_lines(spark, sf_dir)
    return manuals.section_texts(lines, manuals.sections(lines), subsections=True).select("id", "slug", F.md5("text").alias("text_md5"))


@query(f"""WITH {SECTIONS}, w AS (SELECT l.*, s.slug FROM l ASOF LEFT JOIN s ON l.id = s.id AND l.line_no >= s.line_no WHERE contains(lower(line), 'tion')),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY regexp_matches(line, '\\.{{3,}}') OR contains(line, '參閱'), line_no) AS nth FROM w)
SELECT id, nth, line_no, slug, left(trim(line, ' '), 110) AS preview FROM r WHERE nth <= 5""")
def section_search(spark, sf_dir):
    """A document's first five lines with a phrase, and their sections."""
    lines = manual_lines(spark, sf_dir)
    return manuals.search(lines, manuals.sections(lines), "tion", 5)


@query(f"""WITH {LINES}, c AS (SELECT l.id, l.line_no, line, h.level, CASE WHEN h.level IS NOT NULL THEN
    trim(regexp_replace(regexp_replace(regexp_replace(h.title, '^\\s*[*_]+', ''), '[*_]+\\s*$', ''), '\\s+', ' ', 'g')) END AS title FROM l LEFT JOIN h USING (id, line_no)),
g AS (SELECT *, count(level) OVER (PARTITION BY id ORDER BY line_no) AS nth FROM c),
p AS (SELECT id, nth, max(title) AS title, max(level) AS level, trim(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (level IS NULL), ''), ' ' || chr(9) || chr(13) || chr(10)) AS body FROM g GROUP BY 1, 2)
SELECT id, nth, coalesce(title, 'Introduction') AS title, coalesce(level, 0) AS level, md5(body) AS body_md5, 'Generic' AS vehicle_model,
  len(list_distinct(regexp_extract_all(concat_ws(' ', title, body), '\\b[PCBU]\\d{{4}}\\b'))) AS n_codes FROM p WHERE nth > 0 OR body <> ''""")
def parsed_sections(spark, sf_dir):
    """R1, F15, F17, F18."""
    out = manuals.parse_sections(manual_lines(spark, sf_dir))
    return out.select("id", "nth", "title", "level", F.md5("body").alias("body_md5"), "vehicle_model", F.size("codes").alias("n_codes"))


@query("""
WITH p AS (SELECT lang AS id, doc_id AS page, CASE WHEN doc_id % 7 = 0 THEN source END AS t FROM documents),
c AS (SELECT id, page, coalesce(last_value(t IGNORE NULLS) OVER (PARTITION BY id ORDER BY page ROWS UNBOUNDED PRECEDING), 'front matter') AS title FROM p),
g AS (SELECT *, CASE WHEN title IS DISTINCT FROM lag(title) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM c WINDOW w AS (PARTITION BY id ORDER BY page)),
r AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY page)::BIGINT AS run FROM g)
SELECT id, run, title, min(page) AS first_page, max(page) AS last_page FROM r GROUP BY 1, 2, 3""")
def chapter_runs(spark, sf_dir):
    """Documents as the pages of a language, each seventh with a chapter's title."""
    pages = table(spark, sf_dir, "documents").select(F.col("lang").alias("id"), F.col("doc_id").alias("page"), F.when(F.col("doc_id") % 7 == 0, F.col("source")).alias("title"))
    return manuals.chapter_runs(manuals.carried_forward(pages))


@query("""
WITH s AS (SELECT user_id AS id, epoch_us(ts) AS s, epoch_us(ts) + (event_id % 9 + 1) * 3600000000 AS e, event_id AS span_id FROM events WHERE event_type = 'view'),
p AS (SELECT user_id AS id, event_id, epoch_us(ts) AS pt FROM events WHERE event_type = 'click')
SELECT p.id, p.event_id, pt AS "at", arg_min(span_id, (e - s, span_id)) AS span_id FROM p LEFT JOIN s ON s.id = p.id AND pt >= s AND pt < e GROUP BY 1, 2, 3""")
def narrowest_view(spark, sf_dir):
    """Each click with the shortest of the user's views around it."""
    e = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    points = e.where("event_type = 'click'").select(F.col("user_id").alias("id"), "event_id", F.col("us").alias("at"))
    spans = e.where("event_type = 'view'").select(F.col("user_id").alias("id"), F.col("us").alias("start"), (F.col("us") + (F.col("event_id") % 9 + 1) * 3_600_000_000).alias("end"), F.col("event_id").alias("span_id"))
    return manuals.narrowest_span(points, spans, ["id"], 4 * 3_600_000_000)


_REQUESTS = ["supplier#000000001", "Supplier 000000002", "00000003", "part-9-9-9", "Suplier#0000007"]


@query(f"""
WITH n AS (SELECT 's' || s_suppkey::VARCHAR AS node_id, s_name AS name FROM supplier), r AS (SELECT unnest({_REQUESTS}) AS request),
x AS (SELECT *, {SHORT.format(SLUG.format('request'))} AS s, {SHORT.format(SLUG.format('name'))} AS slug FROM n, r),
g AS (SELECT *, list_distinct(list_transform(range(1, length(s)), lambda k: substr(s, k, 2))) AS a, list_distinct(list_transform(range(1, length(slug)), lambda k: substr(slug, k, 2))) AS b FROM x),
f AS (SELECT request, node_id, CASE WHEN request = node_id THEN 0 WHEN request = name OR s = slug THEN 1 WHEN contains(name, request) OR contains(slug, s) THEN 2 END AS how,
  len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS share FROM g),
u AS (SELECT request, how, node_id, 0::DOUBLE AS apart FROM f WHERE how IS NOT NULL
  UNION ALL SELECT request, 20, node_id, -share FROM f WHERE share >= 0.3 QUALIFY row_number() OVER (PARTITION BY request ORDER BY share DESC, node_id) <= 5),
m AS (SELECT *, min(how) OVER (PARTITION BY request) AS least FROM u),
o AS (SELECT request, how, string_agg(node_id, ',' ORDER BY apart, node_id) AS node_ids FROM m WHERE how = least GROUP BY 1, 2)
SELECT request, how, node_ids FROM r LEFT JOIN o USING (request)""")
def resolved_nodes(spark, sf_dir):
    """M6, T10."""
    nodes = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node_id"), F.array("s_name").alias("names"))
    requests = spark.createDataFrame([(r,) for r in _REQUESTS], "request string")
    return manuals.resolve(requests, nodes).select("request", "how", F.array_join("node_ids", ",").alias("node_ids"))
