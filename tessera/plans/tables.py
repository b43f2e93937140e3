"""Queries of inserts, merges, deletes, exports, filters and lookups on ordinary tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import filters, relational, writers
from tessera.registry import query
from tessera.sources.tables import table


def _us(name):
    return F.unix_micros(F.col(name).cast("timestamp"))


@query("""
WITH i AS (SELECT doc_id, source, md5(text) AS h FROM documents WHERE doc_id % 3 > 0), e AS (SELECT source, md5(text) AS h FROM documents WHERE doc_id % 3 = 0)
SELECT min(doc_id) AS doc_id, source, h FROM i WHERE (source, h) NOT IN (SELECT (source, h) FROM e) GROUP BY source, h""")
def new_uploads(spark, sf_dir):
    """Texts that a source has not uploaded before, each once."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "source", F.md5("text").alias("h"))
    return writers.new_rows(d.where("doc_id % 3 = 0"), d.where("doc_id % 3 > 0"), ["source", "h"], ["doc_id"]).select("doc_id", "source", "h")


@query("""
WITH i AS (SELECT DISTINCT md5(text) AS h FROM documents WHERE doc_id % 3 > 0 AND text IS NOT NULL), e AS (SELECT md5(text) AS h FROM documents WHERE doc_id % 3 = 0)
SELECT (SELECT count(*) FROM i WHERE h NOT IN (FROM e)) AS inserted, (SELECT count(*) FROM documents WHERE doc_id % 3 > 0 AND text IS NOT NULL) - (SELECT count(*) FROM i WHERE h NOT IN (FROM e)) AS skipped""")
def chunk_inserts(spark, sf_dir):
    """K3: how many rows an insert by checksum adds and skips."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.md5("text").alias("h"))
    return writers.insert_counts(d.where("doc_id % 3 = 0"), d.where("doc_id % 3 > 0"), ["h"])


@query("""
WITH h AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderkey % 4 = 0 GROUP BY 1)
SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders WHERE o_orderkey % 4 > 0) LEFT JOIN h USING (o_custkey) WHERE k + coalesce(n, 0) <= 5""")
def capped_feedback(spark, sf_dir):
    """K9."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return writers.capped(o.where("o_orderkey % 4 = 0"), o.where("o_orderkey % 4 > 0"), ["o_custkey"], ["o_orderkey"], 5).select("o_orderkey")


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) OR c_custkey % 50 = 0 AS chosen FROM customer")
def flagged_goldens(spark, sf_dir):
    """K4: a flag set where the key is in a list."""
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 50 == 0).alias("chosen"))
    return writers.flagged(c, table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "chosen")


@query("""
SELECT s_suppkey, coalesce(n_name, CASE WHEN s_name ILIKE '%1' THEN 'One' END, 'Unknown') AS maker FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 > 0) ON s_nationkey = n_nationkey""")
def backfilled_makers(spark, sf_dir):
    """A column filled from another table, then by a pattern, then by a constant."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.when(F.col("s_name").ilike("%1"), "One").alias("maker"))
    n = table(spark, sf_dir, "nation").where("n_nationkey % 3 > 0").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("maker"))
    return writers.updated_from(s, n, "s_nationkey", ["maker"]).select("s_suppkey", F.coalesce("maker", F.lit("Unknown")).alias("maker"))


@query("""
SELECT 'kept' AS what, l_orderkey AS id, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 2
UNION ALL SELECT 'orphan', p_partkey, 1 FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)""")
def cascaded_deletes(spark, sf_dir):
    """Lines without those of deleted orders, parts that nothing refers to."""
    lines = table(spark, sf_dir, "lineitem").withColumn("o_orderkey", F.col("l_orderkey"))
    kept = writers.cascade(lines, table(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), "o_orderkey").groupBy(F.col("o_orderkey").alias("id")).agg(F.count("*").alias("n"))
    parts = writers.unresolved(table(spark, sf_dir, "part"), lines.where("l_quantity > 49"), "p_partkey", "l_partkey")
    return kept.select(F.lit("kept").alias("what"), "id", "n").unionByName(parts.select(F.lit("orphan").alias("what"), F.col("p_partkey").alias("id"), F.lit(1).cast("long").alias("n")))


@query("""
SELECT entry, sha256('{"comment":' || CASE WHEN c IS NULL THEN 'null' ELSE '"' || c || '"' END || ',"entry":' || entry::VARCHAR || ',"segment":"' || s || '"}') AS content_hash
FROM (SELECT c_custkey AS entry, CASE WHEN c_custkey % 3 > 0 THEN 'no ' || c_custkey::VARCHAR END AS c, c_mktsegment AS s FROM customer)""")
def locked_lines(spark, sf_dir):
    """Entries as canonical JSON lines and their digests."""
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("entry"), F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("no "), F.col("c_custkey").cast("string"))).alias("comment"), F.col("c_mktsegment").alias("segment")
    )
    return writers.locked_lines(c, ["segment", "entry", "comment"]).select("entry", "content_hash")


@query("""
WITH p AS (SELECT c_custkey, 'VJN' || lpad(c_custkey::VARCHAR, 14, '0') AS vin, 'bike ' || c_custkey::VARCHAR AS label FROM customer),
q AS (SELECT *, 'V-' || upper(left(sha256(vin), 8)) AS a, 'V-' || upper(left(sha256(label), 8)) AS b FROM p)
SELECT c_custkey::VARCHAR AS session_id, '# vehicle_id: ' || b || chr(10) || 'seen ' || a || ' and ' || label || chr(10) || a AS body FROM q""")
def anonymised_files(spark, sf_dir):
    """The label goes in its header line only, the vehicle number everywhere."""
    key = F.col("c_custkey").cast("string")
    vin, name = F.concat(F.lit("VJN"), F.lpad(key, 14, "0")), F.concat(F.lit("bike "), key)
    body = F.concat(F.lit("# vehicle_id: "), name, F.lit("\nseen "), vin, F.lit(" and "), name, F.lit("\n"), vin)
    files, _ = writers.anonymised(table(spark, sf_dir, "customer").select(key.alias("session_id"), body.alias("body")))
    return files


@query("""
WITH r AS (SELECT (event_id // 500)::VARCHAR AS session_id, event_id, date_trunc('second', ts) AS at_, event_type, value, user_id FROM events WHERE value IS NOT NULL)
SELECT session_id, md5('Data Log' || chr(10) || 'Start Time: ' || strftime(min(at_), '%Y-%m-%d %H:%M:%S') || chr(10) || repeat('-', 40) || chr(10) || 'Timestamp' || chr(9) || 'USER' || chr(9) || 'view' || chr(10) || repeat('-', 40) || chr(10) ||
  string_agg(strftime(at_, '%Y-%m-%d %H:%M:%S') || chr(9) || user_id::VARCHAR || chr(9) || CASE WHEN event_type = 'view' THEN round(value)::BIGINT::VARCHAR ELSE 'N/A' END, chr(10) ORDER BY event_id)) AS body_md5 FROM r GROUP BY 1""")
def canonical_logs(spark, sf_dir):
    """K1."""
    e = table(spark, sf_dir, "events").where("value IS NOT NULL").select(
        F.expr("cast(event_id div 500 as string)").alias("session_id"), F.col("event_id").alias("row_id"), F.date_trunc("second", "ts").alias("ts"), "event_type", "value", "user_id",
    )
    user = e.select("session_id", "row_id", "ts", F.lit("USER").alias("signal"), F.col("user_id").cast("string").alias("raw"))
    view = e.where("event_type = 'view'").select("session_id", "row_id", "ts", F.lit("view").alias("signal"), F.round("value").cast("long").cast("string").alias("raw"))
    return writers.as_tsv(user.unionByName(view), ["USER", "view"]).select("session_id", F.md5("body").alias("body_md5"))


@query("""
SELECT 'a' AS tab, c_custkey AS id, c_acctbal AS score, NULL AS note FROM customer WHERE c_acctbal > 0 UNION ALL SELECT 'b', s_suppkey, s_acctbal, s_name FROM supplier""")
def migrated_feedback(spark, sf_dir):
    """Rows of tables with unequal columns, copied into one."""
    a = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("score"), F.col("s_name").alias("note"))
    return relational.tagged_union({"a": a, "b": b})


@query("""
SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 1000 AND contains(lower(o_orderpriority), 'urg')) AS total
FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 1000 AND contains(lower(o_orderpriority), 'urg') ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 20""")
def order_list(spark, sf_dir):
    """P11-P13, G18, T13."""
    o = filters.listed(table(spark, sf_dir, "orders"), equal={"o_orderstatus": "O", "o_custkey": None}, at_least={"o_totalprice": 1000}, contains={"o_orderpriority": "URG"})
    return filters.page_with_total(o, [F.desc("o_orderdate"), "o_orderkey"], 20, 20).select("o_orderkey", "total")


@query("""
WITH u AS (SELECT 'customer' AS tab, c_custkey AS id, c_acctbal AS score FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier)
SELECT tab, id, (SELECT count(*) FROM u) AS total FROM u ORDER BY score DESC, tab, id LIMIT 15 OFFSET 5""")
def feedback_page(spark, sf_dir):
    """T12, G18."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"))
    u = relational.tagged_union({"customer": c, "supplier": table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("score"))})
    return filters.page_with_total(u, [F.desc("score"), "tab", "id"], 15, 5).select("tab", "id", "total")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT -c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def reviewed_or_not(spark, sf_dir):
    """P12, J5, J6."""
    c, o = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").withColumn("c_custkey", F.col("o_custkey"))
    return filters.with_or_without(c, o, "c_custkey", False).unionByName(filters.with_or_without(c, o.where("o_orderstatus = 'P'"), "c_custkey", True).select((-F.col("c_custkey")).alias("c_custkey")))


@query("""
WITH s AS (SELECT doc_id, source, (regexp_matches(left(text, 30), 'a.b') OR regexp_matches(text, 'zz+')) AND length(text) >= 200 AS m FROM documents WHERE text IS NOT NULL)
SELECT doc_id FROM (SELECT *, bool_or(m) OVER (PARTITION BY source) AS some_ FROM s) WHERE m OR NOT some_""")
def chosen_sections(spark, sf_dir):
    """P17."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "source", F.substring("text", 1, 30).alias("title"), F.col("text").alias("body"))
    x = d.withColumn("title", F.when(F.col("title").rlike("a.b"), "zz").otherwise(""))
    return filters.section_choice(x, "source", "zz+").select("doc_id")


@query("SELECT 'o_orderstatus' AS \"column\", o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2")
def counts_by_column(spark, sf_dir):
    """P19."""
    return filters.counts_by(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


@query("""
WITH t AS (SELECT n_nationkey AS manual_id, lower(regexp_replace(n_name, '[\\s_\\-./]+', '', 'g')) AS token FROM nation), i AS (SELECT c_custkey AS id, lower('about' || n_name || CASE WHEN c_custkey % 5 = 0 THEN 'and' || r_name ELSE '' END) AS text FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey),
m AS (SELECT id, count(DISTINCT manual_id) AS n, min(manual_id) AS manual_id FROM i JOIN t ON contains(regexp_replace(text, '[\\s_\\-./]+', '', 'g'), token) AND length(token) >= 4 GROUP BY 1)
SELECT i.id, CASE WHEN n = 1 THEN manual_id END AS manual_id FROM i LEFT JOIN m USING (id)""")
def pinned_manuals(spark, sf_dir):
    """J14."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("r_regionkey") == F.col("n_regionkey"))
    text = F.concat(F.lit("About "), "n_name", F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit(" and-"), "r_name")).otherwise(""))
    return filters.pinned(c.select(F.col("c_custkey").alias("id"), text.alias("text")), n.select(F.col("n_nationkey").alias("manual_id"), F.col("n_name").alias("token")))


@query("""
WITH k AS (SELECT l_orderkey AS id, l_linenumber AS nth, 'part-' || l_partkey::VARCHAR AS known FROM lineitem), c AS (SELECT l_orderkey AS id, l_linenumber AS position,
  CASE l_linenumber % 3 WHEN 0 THEN 'Part ' || l_partkey::VARCHAR WHEN 1 THEN 'rt-' || (l_partkey // 10)::VARCHAR ELSE 'part-' || l_partkey::VARCHAR END AS slug FROM lineitem),
x AS (SELECT c.*, known, nth, CASE WHEN slug = known THEN 0 WHEN replace(lower(slug), ' ', '-') = known THEN 1 WHEN contains(known, replace(lower(slug), ' ', '-')) THEN 2 END AS rank FROM c LEFT JOIN k USING (id)),
b AS (SELECT id, position, slug, arg_min(known, (rank, nth, known)) FILTER (rank IS NOT NULL) AS known FROM x GROUP BY 1, 2, 3)
SELECT id, coalesce(known, slug) AS slug, min(position) AS position FROM b GROUP BY 1, 2""")
def canonical_slugs(spark, sf_dir):
    """F35, U9."""
    x, part = table(spark, sf_dir, "lineitem"), F.col("l_partkey").cast("string")
    known = x.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("nth"), F.concat(F.lit("part-"), part).alias("known"))
    k = F.col("l_linenumber") % 3
    slug = F.when(k == 0, F.concat(F.lit("Part "), part)).when(k == 1, F.concat(F.lit("rt-"), F.expr("cast(l_partkey div 10 as string)"))).otherwise(F.concat(F.lit("part-"), part))
    return filters.canonical_slugs(x.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("position"), slug.alias("slug")), known, S.slug)


@query("""
WITH s AS (SELECT n_regionkey AS id, regexp_replace(lower(n_name), '[^a-z0-9-]+', '-', 'g') AS slug FROM nation), r AS (SELECT r_regionkey AS id, unnest(['Nation 1', 'nation-1x', 'natoin_2', 'q', 'NATION-12']) AS name FROM region),
x AS (SELECT r.*, slug, regexp_replace(lower(name), '[^a-z0-9-]+', '-', 'g') AS made FROM r JOIN s USING (id)),
y AS (SELECT *, 1 - levenshtein(made, slug) / greatest(length(made), length(slug), 1) AS alike FROM x),
z AS (SELECT *, CASE WHEN made = slug THEN 0.0 WHEN contains(slug, made) OR contains(made, slug) THEN 1.0 WHEN alike >= 0.4 THEN 3 - alike END AS rank FROM y),
b AS (SELECT id, name, arg_min(slug, (rank, slug)) FILTER (rank IS NOT NULL) AS slug FROM z GROUP BY 1, 2) SELECT id, name, slug FROM r LEFT JOIN b USING (id, name)""")
def closest_slugs(spark, sf_dir):
    """F34, by edit distance."""
    slugs = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("id"), S.slug(F.col("n_name")).alias("slug"))
    names = F.explode(F.array(*[F.lit(n) for n in ("Nation 1", "nation-1x", "natoin_2", "q", "NATION-12")]))
    return filters.closest_slug(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), names.alias("name")), slugs, S.slug)


@query("""
WITH c AS (SELECT user_id AS id, epoch_us(ts) AS first, epoch_us(ts) + 7200000000 AS last, event_id AS chapter FROM events WHERE event_type = 'signup'),
x AS (SELECT e.event_id, c.chapter, c.last, epoch_us(e.ts) AS us FROM (SELECT *, epoch_us(ts) AS us FROM events WHERE event_type = 'click') AS e ASOF LEFT JOIN (SELECT id, first, max((last, chapter)) AS m, m[1] AS last, m[2] AS chapter FROM c GROUP BY id, first) AS c ON e.user_id = c.id AND e.us >= c.first)
SELECT event_id, CASE WHEN us <= last THEN chapter END AS chapter FROM x""")
def clicks_in_chapters(spark, sf_dir):
    """Each click with the sign-up of the two hours before."""
    e = table(spark, sf_dir, "events").withColumn("us", _us("ts")).withColumnRenamed("user_id", "id")
    chapters = e.where("event_type = 'signup'").select("id", F.col("us").alias("first"), (F.col("us") + 7_200_000_000).alias("last"), F.col("event_id").alias("chapter"))
    return filters.nested_in(e.where("event_type = 'click'").select("id", "event_id", "us"), chapters, ["id"], F.col("us")).select("event_id", "chapter")
