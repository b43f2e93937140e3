"""The registered queries of the analytics operators on the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import detectors, events, relational, retrieval, rules, statistics, text
from tessera.registry import ORACLE_SQL, QUERIES, query, rounded
from tessera.sources import logs
from tessera.sources.tables import signals, table

SIG = "s AS (SELECT user_id AS session, event_type AS signal, epoch_us(ts) AS us, event_id AS row_id, value FROM events)"
VALID = SIG + ", v AS (SELECT * FROM s WHERE value IS NOT NULL AND NOT isnan(value))"
_r = lambda x, name: f"round({x}, 6) + 0.0 AS {name}"


@query(f"""
WITH {VALID}, o AS (SELECT *, lag(value) OVER w AS b, min(value) OVER g AS lo, max(value) OVER g AS hi FROM v
  WINDOW w AS (PARTITION BY session, signal ORDER BY us, row_id), g AS (PARTITION BY session, signal)),
h AS (SELECT session, signal, CASE WHEN hi > lo THEN least(floor((value - lo) / (hi - lo) * 10), 9) ELSE 0 END AS bin, count(*) AS c FROM o GROUP BY ALL),
e AS (SELECT session, signal, sum(-c / t * log2(c / t)) AS bits FROM (SELECT *, sum(c) OVER (PARTITION BY session, signal)::DOUBLE AS t FROM h) GROUP BY ALL)
SELECT session, signal, {_r('avg(value)', 'mean')}, {_r('stddev_pop(value)', 'std')}, min(value) AS min, max(value) AS max,
  {', '.join(_r(f'quantile_cont(value, {p / 100})', f'p{p}') for p in (5, 25, 50, 75, 95))},
  CASE WHEN count(*) >= 3 AND stddev_pop(value) FILTER (b IS NOT NULL) > 0 AND stddev_pop(b) > 0 THEN {_r('corr(b, value)', 'x').removesuffix(' AS x')} END AS autocorrelation,
  {_r('avg(abs(value - b))', 'mean_abs_change')}, {_r('max(abs(value - b))', 'max_abs_change')}, {_r('avg(value * value)', 'energy')},
  CASE WHEN count(*) >= 2 THEN round(any_value(bits), 6) + 0.0 END AS entropy, count(*) AS valid_count
FROM o JOIN e USING (session, signal) GROUP BY session, signal""")
def signal_profile(spark, sf_dir):
    """G1-G3, W1."""
    out = statistics.profile(signals(spark, sf_dir))
    return rounded(out, "mean", "std", "p5", "p25", "p50", "p75", "p95", "autocorrelation", "mean_abs_change", "max_abs_change", "energy", "entropy")


@query(f"""
WITH {VALID}, o AS (SELECT *, (row_number() OVER w - 1)::DOUBLE AS k, lag(value) OVER w AS b, avg(value) OVER (PARTITION BY session, signal) AS mu FROM v
  WINDOW w AS (PARTITION BY session, signal ORDER BY us, row_id))
SELECT session, signal, count(*) AS n, {_r('avg(value)', 'mean')}, {_r('stddev_pop(value)', 'std')},
  CASE WHEN count(*) >= 2 THEN round(covar_pop(k, value) / var_pop(k), 6) + 0.0 END AS slope,
  CASE WHEN count(*) >= 3 AND var_pop(value) > 0 THEN round(sum((value - mu) * (b - mu)) / ((count(*) - 1) * var_pop(value)), 6) + 0.0 END AS autocorrelation,
  arg_min(value, k) AS first, arg_max(value, k) AS last, arg_min(us, (value, us)) AS min_at, arg_max(us, (value, -us)) AS max_at
FROM o GROUP BY session, signal""")
def signal_stats(spark, sf_dir):
    """G4, G6, G7, G16, W8."""
    return rounded(statistics.window_stats(signals(spark, sf_dir)), "mean", "std", "slope", "autocorrelation")


@query(f"""
WITH {VALID} SELECT session, signal, {_r('quantile_cont(value, 0.25)', 'base')}, {_r('quantile_cont(value, 0.75) - quantile_cont(value, 0.25)', 'iqr')},
  {_r('quantile_cont(value, 0.25) - quantile_cont(value, 0.05)', 'low_whisker')}, {_r('quantile_cont(value, 0.95) - quantile_cont(value, 0.75)', 'high_whisker')}
FROM v GROUP BY ALL""")
def signal_box_plot(spark, sf_dir):
    """G5, G32."""
    return rounded(statistics.box_plot(statistics.profile(signals(spark, sf_dir))), "base", "iqr", "low_whisker", "high_whisker")


@query("""
WITH c AS (SELECT event_type AS signal, CASE event_id % 7 WHEN 0 THEN 'N/A' WHEN 1 THEN 'nan' WHEN 2 THEN '' ELSE value::VARCHAR END AS raw FROM events),
d AS (SELECT signal, count(*) AS total, count(*) FILTER (regexp_matches(raw, '^[+-]?[0-9.]+(e[+-]?[0-9]+)?$')) AS valid FROM c GROUP BY 1)
SELECT signal, total, valid, round(valid / total, 6) AS density,
  CASE WHEN valid = 0 THEN 'all N/A' WHEN valid / total >= 0.99 THEN 'dense' WHEN valid / total >= 0.5 THEN 'sparse (' || floor(100 * valid / total)::INT || '%)'
    ELSE 'very sparse (' || floor(100 * valid / total)::INT || '%)' END AS label FROM d""")
def signal_density(spark, sf_dir):
    """Cells that hold a number; three in seven events lose theirs to the marks of missing values."""
    k = F.col("event_id") % 7
    raw = F.when(k == 0, "N/A").when(k == 1, "nan").when(k == 2, "").otherwise(F.col("value").cast("string"))
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("signal"), raw.alias("raw"))
    return rounded(statistics.density(rows, S.number(F.col("raw")).isNotNull()), "density")


@query(f"""
WITH {VALID} SELECT session, signal, row_id, round((value - avg(value) OVER g) / CASE WHEN stddev_pop(value) OVER g > 0 THEN stddev_pop(value) OVER g ELSE 1 END, 6) + 0.0 AS z
FROM v WINDOW g AS (PARTITION BY session, signal)""")
def signal_z_scores(spark, sf_dir):
    """W21."""
    return rounded(statistics.z_scores(signals(spark, sf_dir)).select("session", "signal", "row_id", "z"), "z")


@query("""
WITH c AS (SELECT o_custkey, o_orderpriority AS common, count(*) AS n FROM orders GROUP BY ALL)
SELECT o_custkey, sum(n)::BIGINT AS total, max(n) AS n, arg_min(common, (-n, common)) AS common, round(max(n) / sum(n), 6) AS share, max(n) / sum(n) >= 0.9 AS dominant FROM c GROUP BY 1""")
def dominant_priority(spark, sf_dir):
    """G17."""
    return rounded(statistics.dominant_value(table(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderpriority")), "share")


@query(f"""
WITH {SIG} SELECT session, min(us) AS start_us, max(us) AS end_us, (max(us) - min(us)) // 1000000 AS seconds, count(*) AS n,
  ((max(us) - min(us)) // 60000000)::VARCHAR || 'm ' || ((max(us) - min(us)) // 1000000 % 60)::VARCHAR || 's' AS duration FROM s GROUP BY 1""")
def time_range(spark, sf_dir):
    """G9, F6."""
    out = signals(spark, sf_dir).groupBy("session").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.expr("(max(us) - min(us)) div 1000000").alias("seconds"), F.count("*").alias("n"))
    return out.withColumn("duration", S.duration(F.col("seconds")))


@query(f"""
WITH {SIG} SELECT session, signal, round(min(value), 2) AS min, round(max(value), 2) AS max, round(arg_max(value, (us, row_id)), 2) AS latest, count(value) AS n FROM s GROUP BY ALL""")
def legacy_summary(spark, sf_dir):
    """G8."""
    x = signals(spark, sf_dir)
    last = F.max_by("value", F.struct("us", "row_id"))
    return x.groupBy("session", "signal").agg(F.round(F.min("value"), 2).alias("min"), F.round(F.max("value"), 2).alias("max"), F.round(last, 2).alias("latest"), F.count("value").alias("n"))


def _events_sql(met: str, peak: str, least: float, gap: float) -> str:
    return f"""
WITH {SIG}, o AS (SELECT *, lag(value) OVER w AS b, lag(us) OVER w AS bu FROM s WINDOW w AS (PARTITION BY session, signal ORDER BY us, row_id)),
m AS (SELECT *, coalesce({met}, false) AS met FROM o),
g AS (SELECT *, met AND NOT coalesce(lag(met) OVER w, false) AS opens FROM m WINDOW w AS (PARTITION BY session, signal ORDER BY us, row_id)),
i AS (SELECT *, sum(opens::INT) OVER (PARTITION BY session, signal ORDER BY us, row_id) AS island FROM g),
e AS (SELECT session, signal, island, min(us) AS a, max(us) AS z, {peak}(value) AS p, count(*) AS n FROM i WHERE met GROUP BY ALL HAVING (max(us) - min(us)) / 1e6 >= {least}),
f AS (SELECT *, (a - max(z) OVER (PARTITION BY session, signal ORDER BY a, island ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) / 1e6 AS apart FROM e),
h AS (SELECT *, sum(coalesce((apart > {gap})::INT, 1)) OVER (PARTITION BY session, signal ORDER BY a, island) AS event FROM f)
SELECT session, signal, min(a) AS start_us, max(z) AS end_us, {peak}(p) AS peak, sum(n)::BIGINT AS n_rows, (max(z) - min(a)) / 1e6 AS seconds FROM h GROUP BY session, signal, event"""


@query(_events_sql("value > 40", "max", 1.0, 86400.0))
def find_events_above(spark, sf_dir):
    """P8, W4-W6."""
    return events.find_events(signals(spark, sf_dir), "above", 40.0, 1.0, 86400.0)


@query(_events_sql("b >= 30 AND value < 30", "min", 0.0, 3600.0))
def find_events_falling(spark, sf_dir):
    """falling_below."""
    return events.find_events(signals(spark, sf_dir), "falling_below", 30.0, 0.0, 3600.0)


@query(_events_sql("CASE WHEN us > bu THEN (value - b) / ((us - bu) / 1e6) END > 0.01", "max", 0.0, 0.0))
def find_events_rate(spark, sf_dir):
    """rate_of_change_above, W2."""
    return events.find_events(signals(spark, sf_dir), "rate_of_change_above", 0.01, 0.0, 0.0)


@query(f"""
WITH {SIG}, o AS (SELECT session, signal, us, row_id, round(value, 0) AS value FROM s),
d AS (SELECT *, lag(value) OVER w AS b, row_number() OVER w AS k FROM o WINDOW w AS (PARTITION BY session, signal ORDER BY us, row_id))
SELECT session, signal, row_id, value FROM d WHERE k = 1 OR value IS DISTINCT FROM b""")
def consecutive_distinct(spark, sf_dir):
    """W3."""
    x = signals(spark, sf_dir).withColumn("value", F.round("value", 0))
    return events.consecutive_distinct(x).select("session", "signal", "row_id", "value")


@query(f"""
WITH {SIG}, o AS (SELECT *, row_number() OVER (PARTITION BY session, signal ORDER BY us, row_id) - 1 AS k, count(*) OVER (PARTITION BY session, signal) AS t FROM s),
c AS (SELECT DISTINCT session, signal, t, least(floor(i * t / 5.0)::BIGINT, t - 1) AS k FROM o, range(5) AS r(i))
SELECT session, signal, row_id, k, value FROM o WHERE t <= 5 OR k = 0 OR k = t - 1 OR (session, signal, k) IN (SELECT (session, signal, k) FROM c)""")
def read_window(spark, sf_dir):
    """P5, W18."""
    out = events.read_window(signals(spark, sf_dir), None, None, 5)
    return out.select("session", "signal", "row_id", F.col("k").cast("long").alias("k"), "value")


_GRID = 6 * 3600 * 1_000_000


@query(f"""
WITH {VALID}, m AS (SELECT session, signal, us, avg(value) AS value FROM v GROUP BY ALL),
g AS (SELECT session, signal, unnest(range(min(us), max(us) + 1, {_GRID})) AS us FROM m GROUP BY session, signal),
l AS (SELECT g.*, m.us AS lu, m.value AS lv FROM g ASOF JOIN m ON g.session = m.session AND g.signal = m.signal AND g.us >= m.us),
r AS (SELECT g.*, m.us AS ru, m.value AS rv FROM g ASOF JOIN m ON g.session = m.session AND g.signal = m.signal AND g.us <= m.us)
SELECT session, signal, us, round(CASE WHEN lu = us THEN lv ELSE lv + (rv - lv) * ((us - lu) / (ru - lu)) END, 6) + 0.0 AS value FROM l JOIN r USING (session, signal, us)""")
def resample_interpolated(spark, sf_dir):
    """A1, G13, U3, W20, D5."""
    return rounded(events.resample(statistics.mean_of_duplicates(signals(spark, sf_dir)), _GRID), "value")


@query(f"""
WITH {VALID}, m AS (SELECT session, signal, us, avg(value) AS value FROM v GROUP BY ALL),
g AS (SELECT session, signal, unnest(range(min(us), max(us) + 1, {_GRID})) AS us FROM m GROUP BY session, signal)
SELECT g.session, g.signal, g.us, round(m.value, 6) + 0.0 AS value FROM g ASOF JOIN m ON g.session = m.session AND g.signal = m.signal AND g.us >= m.us""")
def resample_forward(spark, sf_dir):
    """A1, W19."""
    return rounded(events.resample(statistics.mean_of_duplicates(signals(spark, sf_dir)), _GRID, "ffill"), "value")


@query("""
SELECT p.event_id, p.user_id, v.event_id AS asof
FROM events AS p ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY ALL) AS v
  ON p.user_id = v.user_id AND p.ts >= v.ts WHERE p.event_type = 'purchase'""")
def asof_last_view(spark, sf_dir):
    """Each purchase with the user's last view."""
    e = table(spark, sf_dir, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'view'").select("event_id", "user_id", "ts")
    return events.asof_backward(left, right, ["user_id"], "ts", "event_id", "event_id").select("event_id", "user_id", "asof")


@query("""
WITH p AS (SELECT epoch_us(l_shipdate) AS us, l_suppkey, l_linenumber, l_quantity FROM lineitem WHERE l_linenumber IN (1, 2)),
a AS (SELECT DISTINCT l_suppkey, us AS s, us + 2 * 86400000000 AS e FROM p WHERE l_linenumber = 1),
b AS (SELECT DISTINCT l_suppkey, us AS s, us + 3 * 86400000000 AS e FROM p WHERE l_linenumber = 2)
SELECT a.l_suppkey, a.s AS a_start, a.e AS a_end, b.s AS b_start, b.e AS b_end FROM a JOIN b ON a.l_suppkey = b.l_suppkey AND a.s < b.e AND b.s < a.e""")
def interval_overlaps(spark, sf_dir):
    """Overlapping delivery windows of a supplier's first and second lines."""
    x = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("start_us"))
    day = 86_400_000_000
    spans = lambda n, days: x.where(F.col("l_linenumber") == n).select("l_suppkey", "start_us", (F.col("start_us") + days * day).alias("end_us")).distinct()
    return events.overlaps(spans(1, 2), spans(2, 3), ["l_suppkey"], 4 * day)


@query("""
WITH p AS (SELECT DISTINCT l_partkey, l_suppkey, l_linenumber AS n, epoch_us(l_shipdate) AS us FROM lineitem WHERE l_linenumber IN (1, 2)),
a AS (SELECT l_partkey, l_suppkey, us AS s, us + 2 * 86400000000 AS e FROM p WHERE n = 1), b AS (SELECT l_partkey, l_suppkey, us AS s, us + 3 * 86400000000 AS e FROM p WHERE n = 2)
SELECT l_partkey, l_suppkey, a.s AS a_start, a.e AS a_end, b.s AS b_start, b.e AS b_end FROM a JOIN b USING (l_partkey, l_suppkey) WHERE a.s < b.e AND b.s < a.e""")
def part_interval_overlaps(spark, sf_dir):
    """Overlapping delivery windows of the first and second lines of a supplier's part, all quantities."""
    x = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber", F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("start_us"))
    day, keys = 86_400_000_000, ["l_partkey", "l_suppkey"]
    spans = lambda n, days: x.where(F.col("l_linenumber") == n).select(*keys, "start_us", (F.col("start_us") + days * day).alias("end_us")).distinct()
    return events.overlaps(spans(1, 2), spans(2, 3), keys, 4 * day)


@query("""
WITH x AS (SELECT event_id, least(value / 100, 1) AS score, user_id % 9 AS n, event_id % 400 AS seconds, event_type = 'purchase' AS critical FROM events),
y AS (SELECT event_id, 0.40::DOUBLE * score + 0.25::DOUBLE * least(n / 8, 1.0::DOUBLE) + 0.15::DOUBLE * least(seconds / 300, 1.0::DOUBLE) + 0.20::DOUBLE * critical::INT AS c FROM x)
SELECT event_id, round(c, 6) AS composite, CASE WHEN c < 0.33 THEN 'low' WHEN c < 0.66 THEN 'medium' ELSE 'high' END AS severity FROM y""")
def severity_composite(spark, sf_dir):
    """G15."""
    e = table(spark, sf_dir, "events").select(
        "event_id", F.least(F.col("value") / 100, F.lit(1.0)).alias("score"), (F.col("user_id") % 9).alias("n_signals"),
        (F.col("event_id") % 400).alias("seconds"), (F.col("event_type") == "purchase").alias("critical"),
    )
    return rounded(events.severity(e).select("event_id", "composite", "severity"), "composite")


RULES = [
    {"id": "STAT_1", "category": "statistic", "severity": "high", "conditions": [{"type": "stat_check", "signal": "purchase", "field": "max", "op": ">", "value": 60.0}]},
    {"id": "STAT_2", "category": "statistic", "severity": "low", "conditions": [
        {"type": "stat_check", "signal": "view", "field": "mean", "op": ">=", "value": 10.0}, {"type": "signal_exists", "signal": "click"}]},
    {"id": "INTER_1", "category": "interaction", "severity": "medium", "conditions": [
        {"type": "stat_compare", "signal_a": "view", "field_a": "max", "op": ">", "signal_b": "purchase", "field_b": "max", "ratio": 0.9}]},
    {"id": "NEG_1", "category": "negative", "severity": "low", "conditions": [{"type": "signal_exists", "signal": "purchase", "exists": False}]},
]


@query(f"""
WITH {VALID}, p AS (SELECT session, signal, avg(value) AS mean, max(value) AS max FROM v GROUP BY ALL),
w AS (SELECT session, max(max) FILTER (signal = 'purchase') AS pm, max(max) FILTER (signal = 'view') AS vm, max(mean) FILTER (signal = 'view') AS va,
  bool_or(signal = 'click') AS c, bool_or(signal = 'purchase') AS pe FROM p GROUP BY session)
SELECT session, 'STAT_1' AS rule, 'statistic' AS category, 'high' AS severity, 0 AS nth FROM w WHERE pm > 60
UNION ALL SELECT session, 'STAT_2', 'statistic', 'low', 1 FROM w WHERE va >= 10 AND c
UNION ALL SELECT session, 'INTER_1', 'interaction', 'medium', 2 FROM w WHERE vm > pm * 0.9
UNION ALL SELECT session, 'NEG_1', 'negative', 'low', 3 FROM w WHERE NOT pe""")
def rule_findings(spark, sf_dir):
    """A6, A7, J17, D3."""
    p = statistics.valid(signals(spark, sf_dir)).groupBy("session", "signal").agg(F.avg("value").alias("mean"), F.max("value").alias("max"))
    return rules.evaluate(p, RULES, ["mean", "max"]).select("session", "rule", "category", "severity", "nth")


@query("""
SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS similarity
FROM embeddings WHERE label = 3 ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) DESC, id LIMIT 10""")
def vector_top_k(spark, sf_dir):
    """The ten nearest vectors of one label."""
    e = table(spark, sf_dir, "embeddings")
    return rounded(retrieval.vector_top_k(e, e.where("vec_id = 0").select("embedding"), 10, F.col("label") == 3), "similarity")


_TOKENS = ["the", "and", "with"]
_KEY = """k AS (SELECT doc_id AS id, regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+') AS w FROM documents),
q AS (SELECT id, len(list_intersect(list_distinct(w), ['the', 'and', 'with'])) + len(list_filter(w, lambda t: t IN ('the', 'and', 'with'))) / len(w) AS rank FROM k
  WHERE len(list_intersect(list_distinct(w), ['the', 'and', 'with'])) > 0)"""


@query(f"WITH {_KEY} SELECT id, round(rank, 6) AS rank FROM q ORDER BY q.rank DESC, id LIMIT 20")
def keyword_top_k(spark, sf_dir):
    """R8, T3, F33."""
    hits = retrieval.keyword_scores(table(spark, sf_dir, "documents"), _TOKENS, "doc_id", "text")
    return rounded(hits.orderBy(F.desc("rank"), "id").limit(20), "rank")


@query(f"""
WITH {_KEY}, p AS (SELECT * FROM q ORDER BY rank DESC, id LIMIT 40),
s AS (SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS similarity FROM embeddings ORDER BY 2 DESC, 1 LIMIT 20),
f AS (SELECT coalesce(s.id, p.id) AS id, similarity, rank FROM s FULL JOIN p ON s.id = p.id),
x AS (SELECT min(rank) AS lo, max(rank) AS hi FROM p WHERE rank > 0),
y AS (SELECT id, 0.6::DOUBLE * coalesce(similarity, 0) + 0.4::DOUBLE * CASE WHEN rank > 0 THEN CASE WHEN hi > lo THEN (rank - lo) / (hi - lo) ELSE 1 END ELSE 0 END AS score FROM f, x)
SELECT id, round(score, 6) AS score FROM y ORDER BY y.score DESC, id LIMIT 10""")
def hybrid_search(spark, sf_dir):
    """Pools of 40 keyword and 20 vector hits."""
    e = table(spark, sf_dir, "embeddings")
    semantic = retrieval.vector_top_k(e, e.where("vec_id = 0").select("embedding"), 20)
    words = retrieval.keyword_scores(table(spark, sf_dir, "documents"), _TOKENS, "doc_id", "text").orderBy(F.desc("rank"), "id").limit(40)
    return rounded(retrieval.hybrid(semantic, words, 0.6, 10), "score")


@query("""
SELECT code, count(*) AS n, count(DISTINCT id) AS n_docs FROM (SELECT doc_id AS id, unnest(regexp_extract_all(upper(text), '[0-9]{2}[0-9A-F]{4}')) AS code FROM documents) GROUP BY 1""")
def code_sweep(spark, sf_dir):
    """G21, G22, F10."""
    return text.code_sweep(table(spark, sf_dir, "documents"), "[0-9]{2}[0-9A-F]{4}")


@query("""
SELECT id, line_no, left(line, 110) AS preview FROM (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
WHERE contains(lower(line), 'tion in')""")
def literal_search(spark, sf_dir):
    """T8, and M4's line match."""
    return text.literal_search(table(spark, sf_dir, "documents"), "tion in")


@query("""
SELECT line, count(DISTINCT id) AS n_docs FROM (SELECT doc_id AS id, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM documents) WHERE length(line) >= 4 GROUP BY 1 HAVING count(DISTINCT id) > 3""")
def furniture_lines(spark, sf_dir):
    """G24, S15."""
    return text.furniture(table(spark, sf_dir, "documents"), 3)


@query("""
WITH b AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE lang = 'en'), e AS (SELECT DISTINCT unnest(string_split(text, chr(10))) AS line FROM documents WHERE source IN ('src0', 'src1', 'src2')),
x AS (SELECT line, line NOT IN (FROM e) AS lost FROM b)
SELECT count(*) AS n_lines, count(*) FILTER (lost) AS n_missing, round(1 - coalesce(sum(length(line)) FILTER (lost), 0) / sum(length(line)), 6) AS recall FROM x""")
def line_coverage(spark, sf_dir):
    """English lines that documents of three sources hold too."""
    d = table(spark, sf_dir, "documents")
    some = text.lines(d.where(F.col("source").isin("src0", "src1", "src2")))
    return rounded(text.coverage(text.lines(d.where("lang = 'en'")), some), "recall")


@query("""
WITH t AS (SELECT *, turn % 3 = 1 AS calls FROM conversations), o AS (
  SELECT *, role = 'assistant' AND calls AS opens, role = 'assistant' AND NOT calls AS closes FROM t
), g AS (SELECT *, sum((opens OR closes)::INT) OVER w AS mark FROM o WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
h AS (SELECT *, bool_or(opens) OVER (PARTITION BY conv_id, mark) AS step FROM g)
SELECT conv_id, dense_rank() OVER (PARTITION BY conv_id ORDER BY mark)::BIGINT AS iteration, count(*) AS n_turns, sum(length(text))::BIGINT AS n_chars FROM h WHERE step AND mark > 0 GROUP BY conv_id, mark""")
def conversation_iterations(spark, sf_dir):
    """An assistant's turn that calls tools (here each third one of a conversation's turns) opens a step."""
    t = table(spark, sf_dir, "conversations").withColumn("calls_tools", F.col("turn") % 3 == 1)
    return text.iterations(t)


@query("""
SELECT id, chunk_index, sha256(id::VARCHAR || ':' || chunk_index::VARCHAR || ':' || chunk) AS checksum FROM (
  SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS chunk, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS chunk_index FROM documents) WHERE trim(chunk, ' ') <> ''""")
def chunk_checksums(spark, sf_dir):
    """F31."""
    return text.paragraph_chunks(table(spark, sf_dir, "documents")).select("id", "chunk_index", "checksum")


_SLUG = "regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\x{2E80}-\\x{9FFF}\\x{F900}-\\x{FAFF}-]+', '-', 'g'), '^-+|-+$', '', 'g')"
_CUT = "CASE WHEN length(s) <= 80 THEN s ELSE regexp_replace(left(s, 80), '-[^-]*$', '') END AS slug"


@query(f"""
WITH d AS (SELECT doc_id, text, {_SLUG} AS s FROM documents)
SELECT doc_id, greatest(1, length(text) // 4)::BIGINT AS tokens, CASE WHEN length(text) <= 200 THEN text ELSE left(text, 150) || '[cut]' || right(text, 50) END AS short, {_CUT} FROM d""")
def text_shapes(spark, sf_dir):
    """F36, F37, F19."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", S.token_estimate(t).alias("tokens"), S.truncated(t, 200).alias("short"), S.slug(t).alias("slug"))


@query(f"WITH d AS (SELECT doc_id, {_SLUG} AS s FROM documents) SELECT doc_id, {_CUT} FROM d")
def text_slugs(spark, sf_dir):
    """F19."""
    return table(spark, sf_dir, "documents").select("doc_id", S.slug(F.col("text")).alias("slug"))


@query("""
SELECT p_partkey, 'V-' || upper(left(sha256(p_name), 8)) AS pseudonym, printf('%.2f', round((p_size - 32) * 5.0::DOUBLE / 9, 2)) AS celsius, printf('%.2f', round(p_retailprice * 1.60934::DOUBLE, 2)) AS kmh FROM part""")
def unit_conversion(spark, sf_dir):
    """F1, F2, F8."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", S.pseudonym(F.col("p_name")).alias("pseudonym"), S.convert(F.col("p_size").cast("string"), "fahrenheit_to_celsius").alias("celsius"), S.convert(F.col("p_retailprice").cast("string"), "mph_to_kmh").alias("kmh"))


@query("""
WITH r AS (SELECT (event_id // 1000)::VARCHAR AS session_id, row_number() OVER (PARTITION BY event_id // 1000 ORDER BY event_id) - 1 AS row_id, * FROM events)
SELECT session_id, row_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, 'VALUE' AS signal, value FROM r WHERE ts IS NOT NULL
UNION ALL SELECT session_id, row_id, strftime(ts, '%Y-%m-%d %H:%M:%S'), 'USER', user_id FROM r WHERE ts IS NOT NULL""")
def log_rows(spark, sf_dir):
    """Logs of 1,000 events each, read back."""
    e = table(spark, sf_dir, "events")
    line = F.concat_ws(",", F.coalesce(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("-")), F.coalesce(F.col("value").cast("string"), F.lit("N/A")), F.col("user_id").cast("string"))
    x = e.select(F.expr("cast(event_id div 1000 as string)").alias("session_id"), F.struct("event_id", line.alias("line")).alias("l"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda l: l["line"]), "\n")
    files = x.groupBy("session_id").agg(F.concat(F.lit("Timestamp,VALUE,USER\n"), body).alias("body"))
    return logs.rows(files).select("session_id", "row_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "signal", "value")


@query("""
SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice FROM orders GROUP BY 1""")
def latest_order(spark, sf_dir):
    """W9, K8."""
    return relational.latest_per_group(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_totalprice"])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50")
def order_page(spark, sf_dir):
    """T1."""
    return relational.page(table(spark, sf_dir, "orders"), [F.desc("o_orderdate"), "o_orderkey"], 25, 50).select("o_orderkey", "o_totalprice")


@query("""
SELECT c_custkey, count(o_orderkey) AS n_reviews, epoch_us(max(o_orderdate)) AS latest_us FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def review_counts(spark, sf_dir):
    """G19, J2."""
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    out = relational.with_counts(table(spark, sf_dir, "customer").select("c_custkey"), o, "c_custkey", "o_orderdate")
    return out.select("c_custkey", "n_reviews", F.unix_micros(F.col("latest").cast("timestamp")).alias("latest_us"))


@query("""
SELECT doc_id, 1 - quality AS quality, toxic FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, quality, toxic FROM labels WHERE toxic = 0""")
def golden_upsert(spark, sf_dir):
    """Rows marked toxic come back with the other quality."""
    rows = table(spark, sf_dir, "labels")
    changes = rows.where("toxic = 1").select("doc_id", (1 - F.col("quality")).alias("quality"), "toxic")
    return relational.upsert(rows, changes, "doc_id")


@query("""
SELECT 'customer' AS tab, c_custkey AS id, c_acctbal AS score FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier""")
def feedback_union(spark, sf_dir):
    """U2."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"))
    return relational.tagged_union({"customer": c, "supplier": table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("score"))})


@query("""
WITH e AS (SELECT l_partkey AS k, avg(l_quantity) AS expected FROM lineitem GROUP BY 1), a AS (SELECT l_partkey AS k, quantile_cont(l_quantity, 0.5) AS actual FROM lineitem GROUP BY 1)
SELECT k, round(expected, 6) AS expected, round(actual, 6) AS actual, abs(actual - expected) <= abs(expected) * 0.1::DOUBLE AS ok FROM e JOIN a USING (k)""")
def tolerance_match(spark, sf_dir):
    """A part's median quantity against its mean."""
    x = table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "k")
    e, a = x.groupBy("k").agg(F.avg("l_quantity").alias("expected")), x.groupBy("k").agg(F.percentile("l_quantity", F.lit(0.5)).alias("actual"))
    return rounded(relational.within_tolerance(e, a, "k", 0.1), "expected", "actual")


@query("""
SELECT lang, count(*) AS n, round(avg(s), 6) AS mean, round(quantile_cont(s, 0.5), 6) AS median, round(stddev_samp(s), 6) AS std, min(s) AS min, max(s) AS max, round(avg((s >= 0.7)::INT), 6) AS pass_rate
FROM (SELECT lang, (n_chars % 101) / 100 AS s FROM documents) GROUP BY 1""")
def grade_report(spark, sf_dir):
    """G27, E12."""
    d = table(spark, sf_dir, "documents").select("lang", ((F.col("n_chars") % 101) / 100).alias("s"))
    return rounded(statistics.report(d, "lang", "s"), "mean", "median", "std", "pass_rate")


@query("""
SELECT lang, round(avg(quality) FILTER (toxic = 0), 6) AS ordinary, round(avg(quality) FILTER (toxic = 1), 6) AS toxic, round(avg(quality) FILTER (toxic = 1) - avg(quality) FILTER (toxic = 0), 6) AS delta
FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def lane_means(spark, sf_dir):
    """G29, J1."""
    x = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    mean = lambda t: F.avg(F.when(F.col("toxic") == t, F.col("quality")))
    return rounded(x.groupBy("lang").agg(mean(0).alias("ordinary"), mean(1).alias("toxic"), (mean(1) - mean(0)).alias("delta")), "ordinary", "toxic", "delta")


@query()
def change_points(spark, sf_dir):
    """A2: level shifts of each signal of each user."""
    return detectors.change_points(signals(spark, sf_dir))


@query()
def isolation_forest(spark, sf_dir):
    """Runs of odd days, with the signals that make them odd."""
    x = signals(spark, sf_dir)
    wide = x.groupBy("session", F.floor(F.col("us") / 86_400_000_000).alias("day")).pivot("signal", ["view", "click", "purchase", "signup", "error"]).agg(F.avg("value"))
    return detectors.isolation_forest(wide, "session", "day", ["view", "click", "purchase", "signup", "error"])


import tessera.plans.documents  # noqa: E402, F401 these register their queries
import tessera.plans.signals  # noqa: E402, F401
import tessera.plans.evaluation  # noqa: E402, F401
import tessera.plans.streams  # noqa: E402, F401
import tessera.plans.tables  # noqa: E402, F401
import tessera.plans.texts  # noqa: E402, F401
import tessera.plans.indexes  # noqa: E402, F401
import tessera.plans.formats  # noqa: E402, F401
import tessera.plans.trees  # noqa: E402, F401
import tessera.plans.searches  # noqa: E402, F401
