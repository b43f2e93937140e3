"""Queries of signal tools, anomaly events, rules with evidence, and trouble codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import anomalies, codes, events, rules, signals, statistics
from tessera.queries import SIG, VALID, _events_sql
from tessera.registry import query, rounded
from tessera.sources.tables import signals as signal_rows
from tessera.sources.tables import table

NAMES = {"view": "A_KL_RPM", "click": "A_YAM_RPM", "purchase": "COOLANT_TEMP", "signup": "B_WHEEL", "error": "Speed"}
_NAMED = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NAMES.items()) + " END"
INVENTORY = f"i AS (SELECT DISTINCT user_id AS session, {_NAMED} AS signal FROM events)"


def inventory(spark, sf_dir):
    name = F.lit(None)
    for k, v in NAMES.items():
        name = F.when(F.col("event_type") == k, v).otherwise(name)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), name.alias("signal")).distinct()


@query(f"""
WITH {INVENTORY} SELECT session, signal, CASE WHEN starts_with(signal, 'B_') THEN 'abs' ELSE 'engine' END AS subsystem, CASE WHEN ends_with(signal, 'RPM') THEN 'rpm' ELSE 'unknown' END AS unit
FROM i WHERE ends_with(signal, 'RPM') OR signal IN ('B_WHEEL', 'Speed')""")
def signal_inventory(spark, sf_dir):
    """Signals by three patterns."""
    x = inventory(spark, sf_dir)
    x = signals.matching(x, "*rpm").unionByName(signals.matching(x, "B_[w-z]H*", "abs")).unionByName(signals.matching(x, "SPEE?", "engine"))
    return x.select("session", "signal", signals.subsystem(F.col("signal")).alias("subsystem"), signals.unit(F.col("signal")).alias("unit"))


_WANTED = ["RPM", "speed", "A_YAM_RPM", "TEMP", "nothing", ""]


@query(f"""
WITH {INVENTORY}, r AS (SELECT session, unnest({_WANTED}) AS name FROM (SELECT DISTINCT session FROM i)),
x AS (SELECT r.*, i.signal, CASE WHEN name = signal THEN 0 WHEN upper(name) = upper(signal) THEN 1 WHEN name <> '' AND ends_with(upper(signal), upper(name)) THEN 2 END AS rank FROM r JOIN i USING (session)),
b AS (SELECT session, name, arg_min(signal, (rank, CASE WHEN rank = 2 THEN length(signal) ELSE 0 END, signal)) FILTER (rank IS NOT NULL) AS signal FROM x GROUP BY 1, 2)
SELECT session, name, signal FROM r LEFT JOIN b USING (session, name)""")
def resolved_names(spark, sf_dir):
    """F14."""
    x = inventory(spark, sf_dir)
    asked = x.select("session").distinct().withColumn("name", F.explode(F.array(*[F.lit(n) for n in _WANTED])))
    return signals.resolved(asked, x)


@query(f"""
WITH {INVENTORY}, r AS (SELECT session, unnest(['pressure', 'rpm', '']) AS name FROM (SELECT DISTINCT session FROM i)),
x AS (SELECT r.*, signal, len(list_intersect(list_distinct(string_split(lower(signal), '')), list_distinct(string_split(lower(name), '')))) AS shared FROM r JOIN i USING (session)),
y AS (SELECT *, CASE WHEN name <> '' AND contains(lower(signal), lower(name)) THEN 0 WHEN name <> '' AND shared > 0 THEN 10 - shared END AS score FROM x),
z AS (SELECT *, bool_or(score IS NOT NULL) OVER (PARTITION BY session, name) AS any_ FROM y)
SELECT session, name, row_number() OVER w AS nth, signal FROM z WHERE score IS NOT NULL OR NOT any_
WINDOW w AS (PARTITION BY session, name ORDER BY score, CASE WHEN any_ THEN length(signal) END, signal) QUALIFY nth <= 3""")
def suggested_names(spark, sf_dir):
    """T9."""
    x = inventory(spark, sf_dir)
    asked = x.select("session").distinct().withColumn("name", F.explode(F.array(F.lit("pressure"), F.lit("rpm"), F.lit(""))))
    return signals.suggestions(asked, x)


@query(f"""
WITH {INVENTORY} SELECT session, CASE WHEN signal IN ('A_KL_RPM', 'A_YAM_RPM') THEN 'rpm' WHEN signal = 'COOLANT_TEMP' THEN 'degC' ELSE 'unknown' END AS unit, string_agg(signal, ',' ORDER BY signal) AS signals FROM i GROUP BY 1, 2""")
def signals_by_unit(spark, sf_dir):
    """G31."""
    return signals.by_unit(inventory(spark, sf_dir)).select("session", "unit", F.array_join("signals", ",").alias("signals"))


_WINDOWS = """w AS (SELECT user_id AS session, event_id AS window_id, epoch_us(ts) AS start_us, epoch_us(ts) + ((event_id % 13) - 3) * 3600000000 +
  CASE WHEN event_id % 17 = 0 THEN 1000 ELSE 0 END * 86400000000 AS end_us FROM events WHERE event_type = 'signup')"""


def _windows(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'signup'")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    end = us + ((F.col("event_id") % 13) - 3) * 3_600_000_000 + F.when(F.col("event_id") % 17 == 0, 1000).otherwise(0) * 86_400_000_000
    return e.select(F.col("user_id").alias("session"), F.col("event_id").alias("window_id"), us.alias("start_us"), end.alias("end_us"))


@query(f"""
WITH {SIG}, {_WINDOWS}, w2 AS (SELECT session, window_id, start_us + CASE WHEN window_id % 5 = 0 THEN 9000000000000000 ELSE 0 END AS start_us, end_us + CASE WHEN window_id % 5 = 0 THEN 9000000000000000 ELSE 0 END AS end_us FROM w),
p AS (SELECT session, min(us) AS lo, max(us) AS hi FROM s GROUP BY 1)
SELECT session, window_id, start_us, end_us, CASE WHEN start_us > end_us THEN 'inverted' WHEN end_us < lo OR start_us > hi THEN 'outside' ELSE 'ok' END AS state FROM w2 JOIN p USING (session)""")
def checked_windows(spark, sf_dir):
    """P6."""
    late = F.when(F.col("window_id") % 5 == 0, F.lit(9_000_000_000_000_000)).otherwise(0)
    w = _windows(spark, sf_dir).withColumn("start_us", F.col("start_us") + late).withColumn("end_us", F.col("end_us") + late)
    return signals.checked_windows(w, signal_rows(spark, sf_dir))


@query(f"""
WITH {SIG}, {_WINDOWS} SELECT session, window_id, row_id, signal, value FROM s JOIN w USING (session) WHERE us BETWEEN start_us AND end_us""")
def rows_in_windows(spark, sf_dir):
    """P5: closed windows with both bounds."""
    return signals.within(signal_rows(spark, sf_dir), _windows(spark, sf_dir)).select("session", "window_id", "row_id", "signal", "value")


@query(f"""
WITH {SIG}, o AS (SELECT *, row_number() OVER (PARTITION BY session, signal ORDER BY us, row_id) - 1 AS k FROM s) SELECT session, signal, row_id FROM o WHERE k % 4 = 0""")
def every_fourth(spark, sf_dir):
    """every_nth."""
    return signals.every_nth(signal_rows(spark, sf_dir), 4).select("session", "signal", "row_id")


@query(f"""
WITH {SIG}, r AS (SELECT session, signal, CASE WHEN session % 3 = 0 THEN 1.0 ELSE value END AS value FROM s)
SELECT session, signal FROM r WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY 1, 2 HAVING min(value) < max(value)""")
def variable_signals(spark, sf_dir):
    """A third of the sessions has constant values."""
    x = signal_rows(spark, sf_dir).withColumn("value", F.when(F.col("session") % 3 == 0, 1.0).otherwise(F.col("value")))
    return signals.variable_signals(x)


_ABOVE = _events_sql("value > 40", "max", 1.0, 86400.0)
_FALLING = _events_sql("b >= 30 AND value < 30", "min", 0.0, 3600.0)


@query(f"WITH e AS ({_ABOVE}) SELECT *, row_number() OVER (PARTITION BY session, signal ORDER BY start_us) AS nth FROM e QUALIFY nth <= 2")
def first_two_events(spark, sf_dir):
    """T7."""
    return signals.first_events(events.find_events(signal_rows(spark, sf_dir), "above", 40.0, 1.0, 86400.0), 2)


def _anomalies(spark, sf_dir):
    """Events of two detectors with signals, scores and patterns."""
    x = signal_rows(spark, sf_dir)
    a = events.find_events(x, "above", 40.0, 1.0, 86400.0).withColumn("detector", F.lit("changepoint"))
    b = events.find_events(x, "falling_below", 30.0, 0.0, 3600.0).withColumn("detector", F.lit("isolation_forest"))
    both = a.unionByName(b)
    return both.select("session", "start_us", "end_us", F.array("signal").alias("signals"), F.concat_ws(" ", "detector", "signal").alias("pattern"), "detector", F.least(F.lit(1.0), F.col("peak") / 100).alias("score"))


_ANOMALIES = f"""a AS ({_ABOVE}), f AS ({_FALLING}), u AS (
  SELECT session, start_us, end_us, signal, 'changepoint ' || signal AS pattern, 'changepoint' AS detector, least(1.0, peak / 100)::DOUBLE AS score FROM a
  UNION ALL SELECT session, start_us, end_us, signal, 'isolation_forest ' || signal, 'isolation_forest', least(1.0, peak / 100)::DOUBLE FROM f)"""
_CONTEXT = """k AS (
  SELECT u.session, u.start_us, u.end_us, u.pattern, avg(v.value) FILTER (v.signal = 'view') AS rpm, avg(v.value) FILTER (v.signal = 'click') AS speed,
    count(v.value) FILTER (v.signal = 'purchase') AS n, stddev_pop(v.value) FILTER (v.signal = 'purchase') AS spread
  FROM u LEFT JOIN v ON v.session = u.session AND v.us BETWEEN u.start_us AND u.end_us GROUP BY 1, 2, 3, 4
), c AS (SELECT u.*, CASE WHEN rpm IS NULL OR speed IS NULL THEN 'unknown' WHEN rpm < 50 THEN 'off' WHEN speed < 5 THEN 'idle' WHEN n >= 2 THEN CASE WHEN spread <= 3 THEN 'cruise' ELSE 'acceleration' END
  ELSE 'unknown' END AS context FROM u JOIN k USING (session, start_us, end_us, pattern))"""


@query(f"WITH {_ANOMALIES}, {VALID}, {_CONTEXT} SELECT session, start_us, end_us, pattern, context FROM c")
def driving_contexts(spark, sf_dir):
    """G14."""
    x = anomalies.driving_context(_anomalies(spark, sf_dir), signal_rows(spark, sf_dir), "view", "click", "purchase", 86_400_000_000)
    return x.select("session", "start_us", "end_us", "pattern", "context")


@query(f"""
WITH {_ANOMALIES}, {VALID}, {_CONTEXT},
b AS (SELECT *, CASE WHEN start_us > max(end_us) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 WHEN row_number() OVER w = 1 THEN 1 ELSE 0 END AS opens FROM c
  WINDOW w AS (PARTITION BY session ORDER BY start_us, end_us, detector, pattern)),
r AS (SELECT *, sum(opens) OVER (PARTITION BY session ORDER BY start_us, end_us, detector, pattern) AS run FROM b),
l AS (SELECT session, run, min(start_us) AS start_us, max(end_us) AS end_us, list(score ORDER BY start_us, end_us, detector, pattern) AS scores, list(signal ORDER BY start_us, end_us, detector, pattern) AS all_,
  string_agg(pattern, '; ' ORDER BY start_us, end_us, detector, pattern) AS pattern, arg_min(context, (start_us, end_us, detector, pattern)) AS context,
  CASE WHEN min(detector) = max(detector) THEN min(detector) ELSE 'combined' END AS detector FROM r GROUP BY 1, 2),
m AS (SELECT *, list_reduce(scores, lambda x, y: (x + y) / 2) AS score, list_sort(list_distinct(all_)) AS sorted FROM l),
t AS (SELECT *, 0.4::DOUBLE * score + 0.25::DOUBLE * least(len(sorted) / 8, 1.0::DOUBLE) + 0.15::DOUBLE * least((end_us - start_us) / 1e6 / 300, 1.0::DOUBLE) + 0.2::DOUBLE * list_contains(sorted, 'purchase')::INT AS total FROM m)
SELECT session, start_us, end_us, array_to_string(sorted, ',') AS signals, pattern, context, detector, round(score, 12) + 0.0 AS score, CASE WHEN total < 0.33 THEN 'low' WHEN total < 0.66 THEN 'medium' ELSE 'high' END AS severity FROM t""")
def anomaly_report(spark, sf_dir):
    """Events of two detectors, with contexts, merged where they overlap."""
    x = anomalies.driving_context(_anomalies(spark, sf_dir), signal_rows(spark, sf_dir), "view", "click", "purchase", 86_400_000_000)
    out = anomalies.merged(x, ("purchase",)).withColumn("signals", F.array_join(F.array_sort("signals"), ","))
    return rounded(out.select("session", "start_us", "end_us", "signals", "pattern", "context", "detector", "score", "severity"), "score", digits=12)


@query(f"""
WITH {VALID}, r AS (SELECT session, signal, us, row_id, CASE WHEN signal = 'error' AND row_id % 50 <> 0 THEN 7.0 ELSE value END AS value FROM v),
q AS (SELECT session, signal, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std, sum(value) AS total, arg_min(value, (us, row_id)) AS first,
  arg_min(value, (us, row_id)) FILTER (signal = 'purchase' AND (value < 5.0 OR value > 60.0)) AS odd FROM r GROUP BY 1, 2),
m AS (SELECT session, signal, max((c, value)) AS most FROM (SELECT session, signal, value, count(*) AS c FROM r GROUP BY 1, 2, 3) GROUP BY 1, 2),
x AS (SELECT q.*, most[1] AS c, most[2] AS common, coalesce(n >= 3 AND std > 0 AND abs(first - mean) > 2 * std, false) AS shifted FROM q JOIN m USING (session, signal))
SELECT session, signal, 'range_shift' AS kind, first AS value, round((total - first) / (n - 1), 6) AS other FROM x WHERE shifted
UNION ALL SELECT session, signal, 'out_of_range', odd, NULL FROM x WHERE odd IS NOT NULL
UNION ALL SELECT session, signal, 'mostly_constant', common, c::DOUBLE FROM x WHERE NOT shifted AND n >= 5 AND c >= 0.9 * n AND c < n""")
def plain_heuristics(spark, sf_dir):
    """A5."""
    odd = (F.col("signal") == "error") & (F.col("row_id") % 50 != 0)
    x = signal_rows(spark, sf_dir).withColumn("value", F.when(odd, 7.0).otherwise(F.col("value")))
    return rounded(anomalies.plain_heuristics(x, {"purchase": (5.0, 60.0)}), "other")


RULES = [
    {"id": "STAT_9", "category": "statistic", "severity": "high", "description": "high", "template": "peak {purchase.max:.2f}, {view.n} views, {unknown}",
     "conditions": [{"type": "stat_check", "signal": "purchase", "field": "max", "op": ">", "value": 60.0}, {"type": "signal_exists", "signal": "view"}]},
    {"id": "ANOM_1", "category": "anomaly", "severity": "medium", "description": "two", "template": "{anomaly_count} events",
     "conditions": [{"type": "anomaly_check", "signal": "view", "min_count": 2}]},
    {"id": "ANOM_2", "category": "anomaly", "severity": "low", "description": "few", "template": "{anomaly_count} idle",
     "conditions": [{"type": "anomaly_check", "context": "idle", "max_count": 0}]},
    {"id": "DTC_1", "category": "dtc", "severity": "high", "description": "P", "template": "codes {matched_dtcs}", "conditions": [{"type": "dtc_check", "mode": "prefix", "prefix": "P0"}]},
    {"id": "NEG_9", "category": "negative", "severity": "low", "description": "no U code, but {odd}", "template": "{nothing.max}", "conditions": [{"type": "dtc_check", "mode": "absent_prefix", "prefix": "U"}]},
]


@query(f"""
WITH {_ANOMALIES}, {VALID}, {_CONTEXT}, p AS (SELECT session, max(value) FILTER (signal = 'purchase') AS pm, count(*) FILTER (signal = 'view') AS vn FROM v GROUP BY 1),
a2 AS (SELECT session, count(*) FILTER (signal = 'view') AS views, count(*) FILTER (context = 'idle') AS idle FROM c GROUP BY 1),
d AS (SELECT user_id AS session, list_sort(list(DISTINCT CASE event_type WHEN 'error' THEN 'P0' || (300 + event_id % 3)::VARCHAR ELSE 'U0100' END)) AS codes FROM events WHERE event_type IN ('error', 'signup') GROUP BY 1),
x AS (SELECT p.*, coalesce(views, 0) AS views, coalesce(idle, 0) AS idle, coalesce(codes, []::VARCHAR[]) AS codes FROM p LEFT JOIN a2 USING (session) LEFT JOIN d USING (session)),
y AS (SELECT *, array_to_string(list_filter(codes, lambda z: starts_with(z, 'P0')), ', ') AS pc, array_to_string(list_filter(codes, lambda z: starts_with(z, 'U')), ', ') AS uc FROM x)
SELECT session, 'STAT_9' AS rule, 0 AS nth, 'peak ' || printf('%.2f', round(pm, 2)) || ', ' || vn::VARCHAR || ' views, N/A' AS clue, 'purchase.max=' || round(pm, 2)::VARCHAR || '|view_present=true' AS evidence FROM y WHERE pm > 60 AND vn > 0
UNION ALL SELECT session, 'ANOM_1', 1, views::VARCHAR || ' events', 'anomaly_events_matched=' || views::VARCHAR || '|anomaly_signal_filter=view' FROM y WHERE views >= 2
UNION ALL SELECT session, 'ANOM_2', 2, '0 idle', 'anomaly_events_matched=0|anomaly_context_filter=idle' FROM y WHERE idle = 0
UNION ALL SELECT session, 'DTC_1', 3, 'codes ' || pc, 'dtc_prefix=P0|dtc_matched=' || pc FROM y WHERE pc <> ''
UNION ALL SELECT session, 'NEG_9', 4, 'no U code, but {{odd}}', 'dtc_absent_prefix=U|dtc_matched=' FROM y WHERE uc = ''""")
def rule_clues(spark, sf_dir):
    """All kinds of conditions, with evidence and texts."""
    x = signal_rows(spark, sf_dir)
    p = statistics.valid(x).groupBy("session", "signal").agg(F.round(F.max("value"), 2).alias("max"), F.count("*").alias("n"))
    found = anomalies.driving_context(_anomalies(spark, sf_dir), x, "view", "click", "purchase", 86_400_000_000).withColumn("severity", F.lit("low"))
    e = table(spark, sf_dir, "events").where("event_type IN ('error', 'signup')")
    code = F.when(F.col("event_type") == "error", F.concat(F.lit("P0"), (300 + F.col("event_id") % 3).cast("string"))).otherwise("U0100")
    got = rules.evaluate(p, rules.validate(RULES), ["max", "n"], found, e.select(F.col("user_id").alias("session"), code.alias("code")))
    return got.select("session", "rule", "nth", "clue", F.array_join("evidence", "|").alias("evidence"))


@query("""
WITH e AS (SELECT event_id // 100 AS session, event_id, event_type, value FROM events),
m AS (SELECT session, upper(to_hex(sha_.h)) AS x, event_id, event_type FROM (SELECT session, event_id, event_type, (event_id * 2654435761) % 4294967296 AS h FROM e WHERE event_type IN ('error', 'signup')) AS sha_),
t AS (SELECT session::VARCHAR AS session_id, CASE WHEN event_id % 2 = 0 THEN '87F1' || lpad(x, 8, '0') || 'CB' ELSE 'P0' || (300 + event_id % 7)::VARCHAR END AS code, CASE event_type WHEN 'error' THEN 'stored' ELSE 'pending' END AS status,
  CASE WHEN event_id % 2 = 0 THEN 'K-Line' ELSE 'engine' END AS ecu FROM m),
d AS (SELECT DISTINCT * FROM t), f AS (SELECT * FROM d AS a WHERE ecu = 'K-Line' OR status = 'stored' OR NOT EXISTS (FROM d AS b WHERE b.session_id = a.session_id AND b.code = a.code AND b.ecu = 'engine' AND b.status = 'stored'))
SELECT session_id, code, status, ecu, CASE WHEN ecu = 'engine' THEN 'standard' ELSE 'yamaha_hex' END AS family FROM f""")
def merged_codes(spark, sf_dir):
    """Codes of header lines and of code columns; a stored code hides a pending one of the columns."""
    e = table(spark, sf_dir, "events").where("event_type IN ('error', 'signup')").withColumn("session_id", F.expr("cast(event_id div 100 as string)"))
    hex_ = F.lpad(F.hex((F.col("event_id") * 2654435761) % 4294967296), 8, "0")
    stored = F.col("event_type") == "error"
    line = F.concat(F.lit("#   KL_"), F.when(stored, "Stored").otherwise("Pending"), F.lit(": 87F1"), hex_, F.lit("CB"))
    heads = e.where("event_id % 2 = 0").groupBy("session_id").agg(F.concat(F.lit("# Yamaha Dual\n# DTCs:\n"), F.array_join(F.collect_list(line), "\n"), F.lit("\nTimestamp,A_KL_RPM\n")).alias("body"))
    code = F.concat(F.lit("P0"), (300 + F.col("event_id") % 7).cast("string"))
    cells = e.where("event_id % 2 = 1").select(
        "session_id", F.col("event_id").alias("row_id"), F.when(stored, "GET_DTC").otherwise("GET_CURRENT_DTC").alias("signal"), F.concat(F.lit("[('"), code, F.lit("', 'some text')]")).alias("raw"),
    )
    both = codes.merged(codes.header_codes(heads), codes.column_codes(cells))
    return codes.filtered(both, "all", "all").select("session_id", "code", "status", "ecu", codes.family(F.col("code")).alias("family"))


@query("""
WITH c AS (SELECT unnest(['P0117', 'P0118', 'P0171', 'P0174', 'P0300', 'P0301', 'P0302', 'P0303', 'P0304']) AS code, unnest(['COOLANT_TEMP,IAT,CTRL_VOLT', 'COOLANT_TEMP,IAT,CTRL_VOLT',
  'SHORT_FUEL_TRIM_1,LONG_FUEL_TRIM_1,MAP,RPM', 'SHORT_FUEL_TRIM_1,LONG_FUEL_TRIM_1,MAP,RPM', 'RPM,ENGINE_LOAD,TIMING_ADVANCE', 'RPM,ENGINE_LOAD', 'RPM,ENGINE_LOAD', 'RPM,ENGINE_LOAD', 'RPM,ENGINE_LOAD']) AS related)
SELECT event_id, q.code, 'text of ' || p_name AS description, coalesce(related, '') AS related, 'engine / powertrain' AS subsystem
FROM (SELECT event_id, 'P0' || (100 + event_id % 250)::VARCHAR AS code FROM events) AS q LEFT JOIN (SELECT 'P0' || (100 + p_partkey)::VARCHAR AS code, p_name FROM part WHERE p_partkey <= 100) AS p USING (code) LEFT JOIN c USING (code)""")
def looked_up_codes(spark, sf_dir):
    """descriptions from a catalog, related signals from the fixed list."""
    asked = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("P0"), (100 + F.col("event_id") % 250).cast("string")).alias("code"))
    catalog = table(spark, sf_dir, "part").where("p_partkey <= 100").select(F.concat(F.lit("P0"), (100 + F.col("p_partkey")).cast("string")).alias("code"), F.concat(F.lit("text of "), "p_name").alias("description"))
    out = codes.looked_up(asked, catalog)
    return out.select("event_id", "code", "description", F.array_join("related", ",").alias("related"), "subsystem")
