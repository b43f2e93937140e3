"""Queries of evaluation metrics: orders in the role of goldens, their lines in that of slugs, citations and codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import texts as X
from tessera.operators import evaluation as E
from tessera.registry import query, rounded
from tessera.sources.tables import table


def _lines(spark, sf_dir, where: str):
    """(entry, slug): the parts of an order's lines as slugs, spelled in two ways."""
    x = table(spark, sf_dir, "lineitem").where(where)
    slug = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("Part-"), F.col("l_partkey").cast("string"))).otherwise(F.concat(F.lit("part_"), F.col("l_partkey").cast("string")))
    return x.select(F.col("l_orderkey").alias("entry"), slug.alias("slug"))


def _slugs(where: str) -> str:
    return f"SELECT DISTINCT l_orderkey AS entry, CASE WHEN l_linenumber % 2 = 0 THEN 'Part-' ELSE 'part_' END || l_partkey::VARCHAR AS slug FROM lineitem WHERE {where}"


_KEY = "regexp_replace(lower(slug), '[^\\p{L}\\p{N}]+', '', 'g')"
_EXPECTED, _SURFACED, _CLAIMS, _READ = "l_linenumber <= 3", "l_linenumber BETWEEN 2 AND 4", "l_linenumber >= 3", "l_linenumber <= 5"
_TEXT = "SELECT l_orderkey AS entry, string_agg('Part   no ' || l_partkey::VARCHAR || ' of ' || l_suppkey::VARCHAR, chr(10) ORDER BY l_linenumber, l_partkey) AS text FROM lineitem WHERE l_linenumber >= 3 GROUP BY 1"
_CTE = f"""en AS (SELECT o_orderkey AS entry FROM orders), ex AS (SELECT *, {_KEY} AS key FROM ({_slugs(_EXPECTED)})), su AS (SELECT *, {_KEY} AS key FROM ({_slugs(_SURFACED)})),
cl AS (SELECT *, {_KEY} AS key FROM ({_slugs(_CLAIMS)})), rd AS ({_slugs(_READ)}), tx AS ({_TEXT}),
qu AS (SELECT DISTINCT l_orderkey AS entry, 'part' || l_partkey::VARCHAR AS key, 'part no ' || l_partkey::VARCHAR || ' of' AS q FROM lineitem WHERE l_linenumber <= 3 AND l_partkey % 3 = 0),
qf AS (SELECT DISTINCT qu.entry, qu.key FROM qu JOIN tx USING (entry) WHERE contains(lower(regexp_replace(text, '\\s+', ' ', 'g')), q)),
co AS (SELECT entry, slug, key FROM ex WHERE (entry, key) IN (SELECT (entry, key) FROM su) OR (entry, key) IN (SELECT (entry, key) FROM qf))"""


def _frames(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    entries = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry"))
    said = F.concat(F.lit("Part   no "), F.col("l_partkey").cast("string"), F.lit(" of "), F.col("l_suppkey").cast("string"))
    rows = lines.where("l_linenumber >= 3").groupBy(F.col("l_orderkey").alias("entry")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", said.alias("t")))).alias("r"))
    texts = rows.select("entry", F.array_join(F.transform("r", lambda r: r["t"]), "\n").alias("text"))
    quotes = lines.where("l_linenumber <= 3 AND l_partkey % 3 = 0").select(
        F.col("l_orderkey").alias("entry"), F.concat(F.lit("PART "), F.col("l_partkey").cast("string")).alias("slug"), F.concat(F.lit("part no "), F.col("l_partkey").cast("string"), F.lit("\nof")).alias("quote"),
    )
    return entries, texts, quotes


@query(f"WITH {_CTE} SELECT entry, slug FROM co")
def covered_slugs(spark, sf_dir):
    """E1, J5, J13, F21, F22."""
    _, texts, quotes = _frames(spark, sf_dir)
    return E.covered(_lines(spark, sf_dir, _EXPECTED), _lines(spark, sf_dir, _SURFACED), quotes, texts)


@query(f"""WITH {_CTE}, a AS (SELECT entry, count(*) AS ne FROM ex GROUP BY 1), b AS (SELECT entry, count(*) AS nh FROM co GROUP BY 1), c AS (SELECT entry, count(*) AS nc FROM cl GROUP BY 1),
m AS (SELECT * FROM cl WHERE (entry, key) IN (SELECT (entry, key) FROM ex)), d AS (SELECT entry, count(*) AS nm FROM m GROUP BY 1),
f AS (SELECT entry, count(*) AS nq FROM co WHERE (entry, key) NOT IN (SELECT (entry, key) FROM m) GROUP BY 1), x AS (FROM en LEFT JOIN a USING (entry) LEFT JOIN b USING (entry) LEFT JOIN c USING (entry) LEFT JOIN d USING (entry) LEFT JOIN f USING (entry)),
g AS (SELECT entry, 1 - count(*) FILTER ((entry, slug) IN (SELECT (entry, slug) FROM cl)) / count(*) AS cost FROM rd GROUP BY 1)
SELECT entry, round(CASE WHEN ne > 0 THEN coalesce(nh, 0) / ne END, 6) AS section_recall,
  round(CASE WHEN ne > 0 THEN CASE WHEN nc IS NULL THEN 1 ELSE least(nc, coalesce(nm, 0) + coalesce(nq, 0)) / nc END END, 6) AS claim_precision, round(coalesce(cost, 0), 6) AS exploration_cost FROM x LEFT JOIN g USING (entry)""")
def section_metrics(spark, sf_dir):
    """E2, E3, U5."""
    entries, texts, quotes = _frames(spark, sf_dir)
    expected, claims = _lines(spark, sf_dir, _EXPECTED), _lines(spark, sf_dir, _CLAIMS)
    covered = E.covered(expected, _lines(spark, sf_dir, _SURFACED), quotes, texts)
    out = E.section_metrics(entries, expected, covered, claims, covered).join(E.exploration_cost(entries, _lines(spark, sf_dir, _READ), claims), "entry")
    return rounded(out, "section_recall", "claim_precision", "exploration_cost")


@query(f"""WITH tx AS ({_TEXT}), t AS (SELECT l_orderkey AS entry, 'NO ' || l_partkey::VARCHAR || ' of' AS term, 'of ' || l_suppkey::VARCHAR AS other, l_linenumber % 2 = 0 AS has FROM lineitem WHERE l_linenumber IN (1, 2, 3)),
h AS (SELECT entry, contains(lower(regexp_replace(text, '\\s+', ' ', 'g')), lower(term)) OR (has AND contains(lower(regexp_replace(text, '\\s+', ' ', 'g')), other)) AS hit FROM t LEFT JOIN tx USING (entry))
SELECT entry, count(*) AS n_terms, count(*) FILTER (hit) AS n_hits, round(count(*) FILTER (hit) / count(*), 6) AS fact_recall,
  round(count(*) FILTER (hit) / count(*) * least(1.0::DOUBLE, (500 + 2500 * count(*)) / greatest(entry % 20000, 1)) * CASE WHEN entry % 20000 > 0 THEN 1 ELSE 0 END, 6) AS fact_density FROM h GROUP BY 1""")
def fact_metrics(spark, sf_dir):
    """E4, E5."""
    _, texts, _ = _frames(spark, sf_dir)
    x = table(spark, sf_dir, "lineitem").where("l_linenumber IN (1, 2, 3)")
    term = F.concat(F.lit("NO "), F.col("l_partkey").cast("string"), F.lit(" of"))
    terms = x.select(F.col("l_orderkey").alias("entry"), term.alias("term"))
    both = x.where("l_linenumber % 2 = 0").select(F.col("l_orderkey").alias("entry"), term.alias("term"), F.concat(F.lit("of "), F.col("l_suppkey").cast("string")).alias("other"))
    # equivalents of one entry's terms: the number of the entry is part of the wording that is looked up
    own = E.fact_recall(terms.withColumn("term", F.concat("term")), texts)
    plain = lambda c: F.lower(X.single_spaced(c))
    other = both.join(texts, "entry", "left").withColumn("more", F.contains(plain(F.col("text")), F.col("other")) & ~F.contains(plain(F.col("text")), plain(F.col("term"))))
    more = other.groupBy("entry").agg(F.count(F.when(F.col("more"), 1)).alias("more"))
    out = own.join(more, "entry", "left").withColumn("n_hits", F.col("n_hits") + F.coalesce("more", F.lit(0))).withColumn("fact_recall", F.col("n_hits") / F.col("n_terms"))
    out = out.withColumn("fact_density", E.fact_density(F.col("n_hits"), F.col("n_terms"), F.col("entry") % 20000))
    return rounded(out.select("entry", "n_terms", "n_hits", "fact_recall", "fact_density"), "fact_recall", "fact_density")


@query("""
WITH o AS (SELECT o_orderkey AS entry, o_custkey % 5 AS v, CASE WHEN o_orderkey % 4 > 0 THEN (o_orderkey % 10) / 10 END AS section_recall, CASE WHEN o_orderkey % 6 > 0 THEN (o_orderkey % 7) / 7 END AS claim_precision,
  (o_orderkey % 3) / 3 AS exploration_cost, (o_orderkey % 11) / 11 AS fact_recall, (o_orderkey % 13) / 13 AS fact_density, (o_orderkey % 2)::DOUBLE AS value_accuracy, (o_orderkey % 9) / 9 AS answer_quality,
  o_orderkey % 3 AS ne, o_orderkey % 4 AS nc, o_orderkey % 5 > 1 AS matched, o_orderkey % 8 AS want, o_orderkey % 9 AS got FROM orders),
p AS (SELECT *, greatest(0.1, 1 - 0.3 * v)::DOUBLE AS hp, CASE WHEN ne = 0 THEN CASE WHEN nc = 0 THEN 1.0 ELSE 0.3 END WHEN nc = 0 THEN 0.0 WHEN matched THEN 1.0 ELSE 0.3 END::DOUBLE AS cq FROM o),
s AS (SELECT *, coalesce(0.25 * section_recall, 0) + coalesce(0.1 * claim_precision, 0) + 0.2 * fact_recall + 0.05 * fact_density + 0.15 * hp + 0.05 * cq + 0.05 * value_accuracy + 0.15 * answer_quality AS x,
  CASE WHEN section_recall IS NULL THEN 0.25 ELSE 0 END + CASE WHEN claim_precision IS NULL THEN 0.1 ELSE 0 END AS na FROM p)
SELECT entry, round(hp, 6) AS hallucination_penalty, cq AS citation_quality, round(CASE WHEN want <= 0 OR got <= 0 THEN 1 ELSE least(1, want / greatest(want, got)) END, 6) AS trajectory_efficiency,
  round(least(1, x / (1 - na)), 6) AS overall FROM s""")
def overall_scores(spark, sf_dir):
    """E3, E6, E9."""
    k = F.col("o_orderkey")
    x = table(spark, sf_dir, "orders").select(
        k.alias("entry"), E.hallucination_penalty(F.col("o_custkey") % 5).alias("hallucination_penalty"), F.when(k % 4 > 0, (k % 10) / 10).alias("section_recall"), F.when(k % 6 > 0, (k % 7) / 7).alias("claim_precision"),
        ((k % 3) / 3).alias("exploration_cost"), ((k % 11) / 11).alias("fact_recall"), ((k % 13) / 13).alias("fact_density"), (k % 2).cast("double").alias("value_accuracy"), ((k % 9) / 9).alias("answer_quality"),
        E.citation_quality(k % 3, k % 4, k % 5 > 1).alias("citation_quality"), E.trajectory_efficiency(k % 8, k % 9).alias("trajectory_efficiency"),
    )
    out = E.overall(x).select("entry", "hallucination_penalty", "citation_quality", "trajectory_efficiency", "overall")
    return rounded(out, "hallucination_penalty", "trajectory_efficiency", "overall")


@query("""
WITH en AS (SELECT o_orderkey AS entry, o_orderkey % 9 = 0 AS none FROM orders),
e AS (SELECT row_number() OVER () AS eid, l_orderkey AS entry, 'S' || (l_partkey % 3)::VARCHAR AS signal, CASE WHEN l_linenumber % 2 = 0 THEN 'max' END AS stat, l_quantity - 25 AS value, 0.5 AS tol,
  CASE WHEN l_linenumber = 3 THEN epoch_us(l_shipdate) END AS s, CASE WHEN l_linenumber = 3 THEN epoch_us(l_shipdate) + 20 * 86400000000 END AS f FROM lineitem WHERE l_linenumber <= 3),
c AS (SELECT row_number() OVER () AS cid, l_orderkey AS entry, 's' || (l_partkey % 3)::VARCHAR AS signal, CASE WHEN l_linenumber % 2 = 0 THEN 'max' ELSE 'min' END AS stat, CASE WHEN l_linenumber < 6 THEN l_quantity - 25 END AS value,
  epoch_us(l_shipdate) AS s, epoch_us(l_shipdate) + 20 * 86400000000 AS f FROM lineitem WHERE l_linenumber >= 4),
p AS (SELECT e.entry, eid, cid, e.value AS ev, c.value AS cv, tol FROM e JOIN c ON e.entry = c.entry AND lower(e.signal) = lower(c.signal) AND (e.stat IS NULL OR e.stat = c.stat) AND (e.s IS NULL OR (e.s < c.f AND c.s < e.f))),
a AS (SELECT entry, count(*) AS ne FROM e GROUP BY 1), b AS (SELECT entry, count(*) AS nc FROM c GROUP BY 1),
g AS (SELECT entry, count(DISTINCT eid) AS eh, count(DISTINCT cid) AS ch, count(*) FILTER (ev IS NOT NULL AND cv IS NOT NULL) AS n, count(*) FILTER (CASE WHEN ev = 0 THEN abs(cv) <= 0.01 ELSE abs(cv - ev) <= abs(ev) * tol END) AS k FROM p GROUP BY 1)
SELECT entry, round(CASE WHEN none THEN (nc IS NULL)::INT WHEN ne IS NULL THEN 1 ELSE coalesce(eh, 0) / ne END, 6) AS signal_recall, round(CASE WHEN none THEN (nc IS NULL)::INT WHEN ne IS NULL OR nc IS NULL THEN 1 ELSE coalesce(ch, 0) / nc END, 6) AS signal_precision,
  round(CASE WHEN none OR coalesce(n, 0) = 0 THEN 1 ELSE k / n END, 6) AS value_accuracy FROM en LEFT JOIN a USING (entry) LEFT JOIN b USING (entry) LEFT JOIN g USING (entry)""")
def signal_metrics(spark, sf_dir):
    """E7, J10, J11, J15."""
    x, day = table(spark, sf_dir, "lineitem"), 86_400_000_000
    us = F.unix_micros(F.col("l_shipdate").cast("timestamp"))
    third, even = F.col("l_linenumber") == 3, F.col("l_linenumber") % 2 == 0
    part = (F.col("l_partkey") % 3).cast("string")
    value = F.col("l_quantity") - 25
    expected = x.where("l_linenumber <= 3").select(
        F.col("l_orderkey").alias("entry"), F.concat(F.lit("S"), part).alias("signal"), F.when(even, "max").alias("stat"), value.alias("value"), F.lit(0.5).alias("tolerance"),
        F.when(third, us).alias("start"), F.when(third, us + 20 * day).alias("end"),
    )
    cited = x.where("l_linenumber >= 4").select(
        F.col("l_orderkey").alias("entry"), F.concat(F.lit("s"), part).alias("signal"), F.when(even, "max").otherwise("min").alias("stat"), F.when(F.col("l_linenumber") < 6, value).alias("value"),
        us.alias("start"), (us + 20 * day).alias("end"),
    )
    entries = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry"), (F.col("o_orderkey") % 9 == 0).alias("no_evidence"))
    return rounded(E.signal_metrics(entries, expected, cited), "signal_recall", "signal_precision", "value_accuracy")


@query("""
WITH en AS (SELECT o_orderkey AS entry, o_orderkey % 9 = 0 AS none FROM orders),
e AS (SELECT row_number() OVER () AS eid, l_orderkey AS entry, 'P' || (l_partkey % 4)::VARCHAR AS code, CASE WHEN l_linenumber = 2 THEN 'stored' END AS status FROM lineitem WHERE l_linenumber <= 2),
c AS (SELECT row_number() OVER () AS cid, l_orderkey AS entry, 'p' || (l_partkey % 4)::VARCHAR AS code, CASE WHEN l_linenumber = 3 THEN 'stored' ELSE 'pending' END AS status FROM lineitem WHERE l_linenumber >= 3),
p AS (SELECT e.entry, count(DISTINCT eid) AS a, count(DISTINCT cid) AS b FROM e JOIN c ON e.entry = c.entry AND lower(e.code) = lower(c.code) AND (e.status IS NULL OR e.status = c.status) GROUP BY 1),
x AS (SELECT entry, count(*) AS ne FROM e GROUP BY 1), y AS (SELECT entry, count(*) AS nc FROM c GROUP BY 1)
SELECT entry, round(CASE WHEN none THEN (nc IS NULL)::INT WHEN ne IS NULL THEN 1 ELSE least(coalesce(a, 0), coalesce(b, 0)) / (ne + coalesce(nc, 0) - least(coalesce(a, 0), coalesce(b, 0))) END, 6) AS code_accuracy
FROM en LEFT JOIN x USING (entry) LEFT JOIN y USING (entry) LEFT JOIN p USING (entry)""")
def code_accuracy(spark, sf_dir):
    """E7, U7."""
    x = table(spark, sf_dir, "lineitem")
    code = lambda p: F.concat(F.lit(p), (F.col("l_partkey") % 4).cast("string")).alias("code")
    key = F.col("l_orderkey").alias("entry")
    expected = x.where("l_linenumber <= 2").select(key, code("P"), F.when(F.col("l_linenumber") == 2, "stored").alias("status"))
    cited = x.where("l_linenumber >= 3").select(key, code("p"), F.when(F.col("l_linenumber") == 3, "stored").otherwise("pending").alias("status"))
    entries = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry"), (F.col("o_orderkey") % 9 == 0).alias("no_evidence"))
    return rounded(E.code_accuracy(entries, expected, cited), "code_accuracy")


@query("""
WITH q AS (SELECT doc_id AS entry, doc_id - doc_id % 2 AS slug, regexp_replace(substr(text, 5, 12), '\\s+', '  ', 'g') AS quote FROM documents), t AS (SELECT doc_id AS slug, text FROM documents),
f AS (SELECT entry, count(*) AS n_quotes, count(*) FILTER (trim(regexp_replace(quote, '\\s+', ' ', 'g')) <> '' AND contains(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), lower(trim(regexp_replace(quote, '\\s+', ' ', 'g'))))) AS n_found FROM q LEFT JOIN t USING (slug) GROUP BY 1),
c AS (SELECT doc_id AS entry, trim(CASE WHEN doc_id % 5 > 0 THEN lang ELSE ' ' END, ' ') <> '' AND source IS NOT NULL AS complete FROM documents)
SELECT entry, complete, coalesce(n_quotes, 0) AS n_quotes, coalesce(n_found, 0) AS n_found, complete AND coalesce(n_quotes, 0) > 0 AND n_quotes = n_found AS accepted FROM c LEFT JOIN f USING (entry)""")
def grounded_candidates(spark, sf_dir):
    """E10."""
    d = table(spark, sf_dir, "documents")
    candidates = d.select(F.col("doc_id").alias("entry"), F.when(F.col("doc_id") % 5 > 0, F.col("lang")).otherwise(" ").alias("lang"), "source")
    quotes = d.select(F.col("doc_id").alias("entry"), (F.col("doc_id") - F.col("doc_id") % 2).alias("slug"), F.regexp_replace(F.substring("text", 5, 12), r"\s+", "  ").alias("quote"))
    return E.grounded(candidates, ["lang", "source"], quotes, d.select(F.col("doc_id").alias("slug"), "text"))


@query("""
WITH r AS (SELECT o_custkey AS entry, epoch_us(o_orderdate) AS dated, CASE WHEN o_orderkey % 7 > 0 THEN CASE WHEN o_orderkey % 3 > 0 THEN 'accept' ELSE 'reject' END END AS verdict, CASE WHEN o_orderkey % 5 > 0 THEN 1 + o_orderkey % 5 END AS stars FROM orders),
l AS (SELECT entry, max((dated, verdict, stars)) AS b FROM r WHERE verdict IS NOT NULL AND stars IS NOT NULL GROUP BY 1)
SELECT c_custkey AS entry FROM customer JOIN l ON entry = c_custkey WHERE b[2] = 'accept' AND b[3] >= 4 AND c_custkey % 10 <> 0 AND c_custkey % 4 <> 0""")
def promotable_entries(spark, sf_dir):
    """E11, J5, J6."""
    k = F.col("o_orderkey")
    reviews = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("entry"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("at"), F.when(k % 7 > 0, F.when(k % 3 > 0, "accept").otherwise("reject")).alias("verdict"), F.when(k % 5 > 0, 1 + k % 5).alias("stars"),
    )
    c = table(spark, sf_dir, "customer")
    uuid = F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.col("c_custkey").cast("string"), 12, "0"))
    entries = c.select(F.col("c_custkey").alias("entry"), F.when(F.col("c_custkey") % 10 == 0, "manual").otherwise(uuid).alias("manual_id"))
    return E.promotable(entries, reviews, c.where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("entry"))).select("entry")


@query("""
WITH d AS (SELECT lang, CASE WHEN doc_id % 3 > 0 THEN (n_chars % 101) / 100 END AS recall, CASE WHEN doc_id % 4 = 0 THEN 'nan'::DOUBLE ELSE (n_chars % 53) / 53 END AS quality FROM documents)
SELECT lang, 'recall' AS dimension, round(avg(recall), 6) AS mean, count(recall) AS n FROM d GROUP BY 1 UNION ALL SELECT lang, 'quality', round(avg(quality) FILTER (NOT isnan(quality)), 6), count(*) FILTER (NOT isnan(quality)) FROM d GROUP BY 1""")
def dimension_means(spark, sf_dir):
    """G28."""
    n = F.col("n_chars")
    d = table(spark, sf_dir, "documents").select("lang", F.when(F.col("doc_id") % 3 > 0, (n % 101) / 100).alias("recall"), F.when(F.col("doc_id") % 4 == 0, float("nan")).otherwise((n % 53) / 53).alias("quality"))
    return rounded(E.dimension_means(d, "lang", ["recall", "quality"]), "mean")


@query("SELECT lang, round(avg(p::INT), 6) AS rate, avg(p::INT) >= 0.85 AS passes, floor((avg(s) - stddev_samp(s)) * 10) / 10 AS threshold FROM (SELECT lang, n_chars % 10 > 1 AS p, (n_chars % 101) / 100 AS s FROM documents) GROUP BY 1")
def probe_rates(spark, sf_dir):
    """The share of probes that pass, and the threshold for later runs."""
    s = (F.col("n_chars") % 101) / 100
    rate = F.avg((F.col("n_chars") % 10 > 1).cast("int"))
    return rounded(table(spark, sf_dir, "documents").groupBy("lang").agg(rate.alias("rate"), (rate >= 0.85).alias("passes"), E.threshold(F.avg(s), F.stddev_samp(s)).alias("threshold")), "rate")
