"""Queries of exact percentiles, the stored keyword index, many patterns, slugs by matching blocks, and metrics by lane."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import evaluation, filters, keywords, patterns, quantiles
from tessera.registry import query, rounded
from tessera.sources.tables import signals, table
from tessera.streaming.live import folder

_LEVELS = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p999": 0.999}


@query(f"""
SELECT event_type AS signal, count(*) AS n, {', '.join(f'round(quantile_cont(value, {p}), 6) + 0.0 AS {name}' for name, p in _LEVELS.items())}
FROM events WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY 1""")
def signal_percentiles(spark, sf_dir):
    """Percentiles of a signal over all sessions, a few keys with all rows."""
    return rounded(quantiles.percentiles(signals(spark, sf_dir), ["signal"], "value", _LEVELS), *_LEVELS)


def _index(spark, sf_dir) -> keywords.KeywordIndex:
    path = folder(spark, "keywords")
    keywords.build(table(spark, sf_dir, "documents"), path, "doc_id", "text")
    return keywords.KeywordIndex(spark, path)


_WORDS = "k AS (SELECT doc_id AS id, regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+') AS w FROM documents)"


@query(f"""
WITH {_WORDS}, q AS (SELECT id, len(list_intersect(list_distinct(w), ['heention', 'then', 'with'])) + len(list_filter(w, lambda t: t IN ('heention', 'then', 'with'))) / len(w) AS rank FROM k
  WHERE len(list_intersect(list_distinct(w), ['heention', 'then', 'with'])) > 0)
SELECT id, round(rank, 6) AS rank FROM q ORDER BY q.rank DESC, id LIMIT 20""")
def indexed_keyword_top_k(spark, sf_dir):
    """The first 20 from a stored index."""
    return rounded(_index(spark, sf_dir).top_k(["heention", "then", "with"], 20), "rank")


@query(f"""
WITH {_WORDS}, n AS (SELECT id, len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) AS n FROM k) SELECT id, n::BIGINT AS n FROM n WHERE n > 0""")
def phrase_hits(spark, sf_dir):
    """Documents with two words one after another, from the positions of a stored index."""
    return _index(spark, sf_dir).phrase(["of", "the"])


@query("""
WITH p AS (SELECT DISTINCT pattern FROM (SELECT unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS pattern FROM benchmark) WHERE length(pattern) >= 6)
SELECT pattern, count(*) AS n_docs FROM p JOIN documents ON contains(text, pattern) GROUP BY 1""")
def pattern_hits(spark, sf_dir):
    """Documents that contain each longer word of the benchmark, within words too."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "[^A-Za-z]+")).alias("pattern")).where(F.length("pattern") >= 6).distinct()
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    found = patterns.found_in(texts, words.select(F.col("pattern").alias("pattern_id"), "pattern"))
    return found.groupBy(F.col("pattern_id").alias("pattern")).agg(F.count("*").alias("n_docs"))


@query()
def slugs_by_blocks(spark, sf_dir):
    """a part's name with its words exchanged, and the nearest name of parts of its size; a test compares with all pairs."""
    p = table(spark, sf_dir, "part")
    known = p.groupBy(F.col("p_size").alias("id"), S.slug(F.col("p_name")).alias("slug")).agg(F.min("p_partkey").alias("nth"))
    asked = p.select(F.col("p_size").alias("id"), F.regexp_replace("p_name", r"^(\w+) (\w+)$", "$2 $1").alias("name"))
    return filters.closest_by_blocks(asked, known, S.slug)


@query("""
WITH o AS (SELECT o_orderkey, (o_orderkey % 7) / 7 AS a, (o_orderkey % 5) / 5 AS b, (o_orderkey % 3) / 3 AS c, o_orderstatus = 'F' AS s FROM orders)
SELECT o_orderkey, round(CASE WHEN s THEN b ELSE a END, 6) AS section_recall, round(CASE WHEN s THEN c ELSE b END, 6) AS claim_precision, round(CASE WHEN s THEN a ELSE c END, 6) AS citation_quality,
  round(CASE WHEN s THEN 0 ELSE a END, 6) AS exploration_cost, round(CASE WHEN s THEN 1 ELSE b END, 6) AS trajectory_efficiency, round(CASE WHEN s THEN c ELSE 1 END, 6) AS value_accuracy FROM o""")
def lane_metrics(spark, sf_dir):
    """Finished orders as questions about signals, the others as questions about manuals."""
    k = F.col("o_orderkey")
    a, b, c = k % 7 / 7, k % 5 / 5, k % 3 / 3
    rows = table(spark, sf_dir, "orders").select(
        k, F.when(F.col("o_orderstatus") == "F", "event_finding").when(F.col("o_orderstatus") == "O", "lookup").alias("question_type"), a.alias("section_recall"), b.alias("claim_precision"),
        c.alias("citation_quality"), b.alias("signal_recall"), c.alias("signal_precision"), a.alias("code_accuracy"), a.alias("exploration_cost"), b.alias("trajectory_efficiency"), c.alias("value_accuracy"),
    )
    return rounded(evaluation.by_lane(rows).drop("question_type"), "section_recall", "claim_precision", "citation_quality", "exploration_cost", "trajectory_efficiency", "value_accuracy")
