"""Queries of text functions and of summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import summaries as M
from tessera.functions import texts as X
from tessera.operators import chunking, manuals
from tessera.plans.documents import manual_lines
from tessera.registry import query
from tessera.sources.tables import table


@query("""
SELECT doc_id, regexp_replace(left(array_to_string(regexp_extract_all(lower(left(text, 200)), '[a-z0-9]+'), '-'), 48), '-+$', '') AS index_slug, md5(regexp_replace(lower(text), '[^一-鿿㐀-䶿a-z0-9]+', '', 'g')) AS letters_md5,
  md5(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ')) AS spaced_md5, false AS cjk, len(regexp_extract_all(text, '&(?:[a-zA-Z]+|#[0-9]+|#x[0-9a-fA-F]+);')) AS n_references FROM documents""")
def normal_forms(spark, sf_dir):
    """F20, F22, F23, F24, F32."""
    d, t = table(spark, sf_dir, "documents"), F.col("text")
    return d.select(
        "doc_id", X.index_slug(F.substring(t, 1, 200)).alias("index_slug"), F.md5(X.letters_only(t)).alias("letters_md5"), F.md5(X.single_spaced(t)).alias("spaced_md5"), X.mostly_cjk(t).alias("cjk"),
        X.pollution(t)["references"].alias("n_references"),
    )


@query("""
WITH s AS (SELECT doc_id, text, left(text, 60 + doc_id % 300) || CASE WHEN doc_id % 4 = 0 THEN ' 987654' ELSE '' END AS summary FROM documents WHERE text IS NOT NULL)
SELECT doc_id, trim(summary, ' ') <> '' AND length(summary) <= 300 AND coalesce(list_bool_and(list_transform(regexp_extract_all(summary, '[PCBU][0-9A-F]{4}|[0-9]+(?:[.][0-9]+)?'), lambda x: contains(text, x))), true) AS fits FROM s""")
def summary_gates(spark, sf_dir):
    """F26."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    summary = F.concat(F.substring("text", F.lit(1), (60 + F.col("doc_id") % 300).cast("int")), F.when(F.col("doc_id") % 4 == 0, " 987654").otherwise(""))
    return d.select("doc_id", X.summary_fits(summary, F.col("text")).alias("fits"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN '' ELSE 'fig ' || p_partkey::VARCHAR || '>a/' || p_partkey::VARCHAR || '.png' END || CASE WHEN p_partkey % 4 = 2 THEN ',x>b.png' ELSE '' END AS refs,
  '![fig ' || p_partkey::VARCHAR || '](' || CASE WHEN p_partkey % 4 = 3 THEN 'http://h/../' ELSE 'images/m/a/' END || p_partkey::VARCHAR || '.png)' || CASE WHEN p_partkey % 4 = 2 THEN ' ![x](images/m/b.png)' ELSE ' ![y](/abs.png)' END AS moved FROM part""")
def image_links(spark, sf_dir):
    """F29, F30."""
    k = F.col("p_partkey").cast("string")
    odd = F.col("p_partkey") % 4
    text = F.concat(F.lit("![fig "), k, F.lit("]("), F.when(odd == 3, "http://h/../").otherwise("a/"), k, F.lit(".png)"), F.when(odd == 2, " ![x](b.png)").otherwise(" ![y](/abs.png)"))
    refs = F.array_join(F.transform(X.image_references(text), lambda r: F.concat(r["alt"], F.lit(">"), r["path"])), ",")
    return table(spark, sf_dir, "part").select("p_partkey", refs.alias("refs"), X.images_below(text, "m").alias("moved"))


@query("""
SELECT c_custkey, CASE c_custkey % 4 WHEN 3 THEN NULL ELSE '{"k": ' || c_custkey::VARCHAR || '}' END AS object, CASE c_custkey % 3 WHEN 0 THEN 'VJN' || lpad(c_custkey::VARCHAR, 14, '0') WHEN 1 THEN 'plain' ELSE NULL END AS vin,
  c_mktsegment AS segment, CASE WHEN c_custkey % 2 = 0 THEN 'a "b" \\ c' END AS note, CASE WHEN c_custkey % 2 = 0 THEN 'omission' ELSE 'assertion' END AS kind, 'a,b c;d' AS cells FROM customer""")
def parsed_texts(spark, sf_dir):
    """F7, F42, F44, F47, F49, S13."""
    k, n = F.col("c_custkey").cast("string"), F.col("c_custkey")
    body = F.concat(F.lit('{"k": '), k, F.lit("}"))
    reply = F.when(n % 4 == 0, body).when(n % 4 == 1, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\n{bad"))).when(n % 4 == 2, F.concat(F.lit("I think "), body, F.lit(" fits"))).otherwise("{broken")
    vin = F.when(n % 3 == 0, F.concat(F.lit("bytearray(b'VJN"), F.lpad(k, 14, "0"), F.lit("')"))).when(n % 3 == 1, " plain ").otherwise("N/A")
    front = X.frontmatter_fields(F.concat(X.frontmatter({"segment": F.col("c_mktsegment"), "note": F.when(n % 2 == 0, F.lit("a b"))}), F.lit("# Text\n")))
    cells = F.array_join(F.transform(X.table_rows(F.lit("<table><TR><td>a</td><td> <b>b</b>\n c</td></tr><tr><th>d</th></tr></table>")), lambda r: F.array_join(r, ",")), ";")
    kind = X.directive_kind(F.when(n % 2 == 0, "Omits the torque value").otherwise("Says the torque is 5"))
    note = F.when(front["note"] == "a b", F.lit('a "b" \\ c'))
    return table(spark, sf_dir, "customer").select("c_custkey", X.json_object(reply).alias("object"), X.vin(vin).alias("vin"), front["segment"].alias("segment"), note.alias("note"), kind.alias("kind"), cells.alias("cells"))


@query("""
WITH s AS (SELECT user_id AS session, count(*) FILTER (event_type = 'error' AND event_id % 4 = 0) AS n4, count(DISTINCT event_id % 6) FILTER (event_type = 'error' AND event_id % 5 = 0) AS nc, max(event_id) % 5 AS m, max(event_id) % 9 = 0 AS f FROM events GROUP BY 1)
SELECT session, CASE WHEN f THEN 3 WHEN nc > 3 OR m = 1 THEN 2 WHEN nc > 1 OR m = 2 THEN 1 ELSE 0 END AS tier, nc AS n_codes, CASE m WHEN 0 THEN 'none' WHEN 1 THEN 'critical' WHEN 2 THEN 'high' ELSE 'moderate' END AS severity, CASE m WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 3 END AS n_clues,
  CASE WHEN f THEN 10 WHEN nc > 3 OR m = 1 THEN 15 ELSE 5 END AS most_steps FROM s""")
def complexity_tiers(spark, sf_dir):
    """F40."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    s = e.groupBy(F.col("user_id").alias("session")).agg(
        F.array_join(F.collect_set(F.when((F.col("event_type") == "error") & (k % 5 == 0), F.concat(F.lit("p010"), (k % 6).cast("string")))), ", ").alias("codes"), F.max("event_id").alias("last"),
    )
    m = F.col("last") % 5
    said = F.when(m == 0, "No anomalies").when(m == 1, "a severe drop, low voltage").when(m == 2, "highly odd; high temperature").otherwise("lowest speed")
    clues = F.when(m == 0, " ").when(m == 1, "STAT_1 x; RULE_2 y; STAT_1 z").otherwise("a; b\nc;")
    x = s.select("session", M.complexity(F.col("codes"), said, clues, F.col("last") % 9 == 0).alias("c")).select("session", "c.*")
    return x.withColumn("most_steps", M.overridden(F.col("tier"), force_agent=True)["most_steps"])


@query("""
WITH p AS (SELECT user_id AS session, event_type, min(value) AS mn, max(value) AS mx, avg(value) AS av, arg_max(value, (ts, event_id)) AS lt FROM events WHERE value IS NOT NULL GROUP BY 1, 2),
l AS (SELECT session, string_agg(event_type || ': min=' || round(mn)::BIGINT::VARCHAR || ' max=' || round(mx)::BIGINT::VARCHAR || ' mean=' || printf('%.2f', round(av)) || ' latest=' || round(lt)::BIGINT::VARCHAR || ' u', chr(10) ORDER BY event_type) AS pids,
  string_agg(event_type, ' ' ORDER BY event_type) FILTER (round(mn) <> round(mx)) AS varying FROM p GROUP BY 1),
t AS (SELECT user_id AS session, date_trunc('second', min(ts)) AS a, date_trunc('second', max(ts)) AS z, count(*) AS n FROM events GROUP BY 1)
SELECT session, strftime(a, '%Y-%m-%d %H:%M:%S') || ' to ' || strftime(z, '%Y-%m-%d %H:%M:%S') || ', ' || n::VARCHAR || 's, ' || n::VARCHAR || ' samples' AS time_range, CASE WHEN session % 3 = 0 THEN 'P0301, U0100' ELSE 'None' END AS codes, pids,
  CASE WHEN session % 3 = 1 THEN '[LOW] drop (context: idle, signals: a, b, score: 0.50)' ELSE 'None' END AS events, 'None' AS clues,
  CASE session % 3 WHEN 0 THEN 'DTC codes: P0301 U0100' WHEN 1 THEN 'Anomalies: drop' ELSE CASE WHEN varying IS NULL THEN 'general OBD vehicle health check' ELSE 'PID fluctuations: ' || varying END END AS rag_query FROM l JOIN t USING (session)""")
def flat_summaries(spark, sf_dir):
    """The stages' results of a session in one document, as flat texts."""
    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "session")
    whole = lambda c: F.round(c).cast("long")
    # sums of doubles depend on their order, and means here can lie halfway between whole numbers: added up in order of ids, that of the table's rows
    series = Window.partitionBy("session", "event_type").orderBy("event_id", "ts", "value").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = e.where("value IS NOT NULL").withColumn("sum", F.sum("value").over(series)).groupBy("session", "event_type").agg(
        F.min("value").alias("mn"), F.max("value").alias("mx"), (F.any_value("sum") / F.count("*")).alias("av"), F.max_by("value", F.struct("ts", "event_id")).alias("lt"),
    )
    pid = F.struct(F.col("event_type").alias("name"), whole("mn").alias("min"), whole("mx").alias("max"), F.round("av").alias("mean"), whole("lt").alias("latest"), F.lit("u").alias("unit"))
    pids = p.groupBy("session").agg(F.array_sort(F.collect_list(pid)).alias("pids"))
    span = e.groupBy("session").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n")).withColumn("seconds", F.col("n"))
    k = F.col("session") % 3
    event = F.array(F.struct(F.lit("low").alias("severity"), F.lit("drop").alias("pattern"), F.lit("idle").alias("context"), F.array(F.lit("a"), F.lit("b")).alias("signals"), F.lit(0.5).alias("score")))
    clue = F.array().cast("array<struct<severity:string,rule:string,clue:string,evidence:array<string>>>")
    x = pids.join(span, "session").withColumn("codes", F.when(k == 0, F.array(F.lit("P0301"), F.lit("U0100"))).otherwise(F.array().cast("array<string>")))
    x = x.withColumn("events", F.when(k == 1, event).otherwise(F.slice(event, 1, 0))).withColumn("clues", clue)
    return M.flattened(x)


@query("""
WITH t AS (SELECT *, turn % 3 = 1 AS calls, row_number() OVER w AS nth, sum((role = 'assistant')::INT) OVER w AS mark FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
a AS (SELECT *, coalesce(bool_or(calls) FILTER (role = 'assistant') OVER (PARTITION BY conv_id, mark), false) AS in_, sum((role = 'assistant' AND calls)::INT) OVER (PARTITION BY conv_id ORDER BY nth) AS s0 FROM t),
b AS (SELECT *, CASE WHEN in_ THEN s0 END AS step, sum(4 + greatest(1, length(coalesce(text, '')) // 4)) OVER (PARTITION BY conv_id) AS tokens FROM a),
c AS (SELECT *, coalesce(max(step) OVER (PARTITION BY conv_id), 0) AS steps FROM b), d AS (SELECT *, tokens > 100 AND steps > 1 AS cut FROM c),
l AS (SELECT conv_id, step, '- Iter ' || step::VARCHAR || ': ' || coalesce(string_agg('tool -> ' || CASE WHEN length(text) > 80 THEN left(text, 80) || '...' ELSE coalesce(text, '') END, ', ' ORDER BY nth) FILTER (NOT (role = 'assistant' AND calls)), 'tool') AS line
  FROM d WHERE cut AND step <= steps - 1 GROUP BY 1, 2)
SELECT conv_id, (CASE WHEN cut AND nth > 2 THEN nth + 1 ELSE nth END)::DOUBLE AS place, role, text FROM d WHERE NOT cut OR nth <= 2 OR (step IS NOT NULL AND step > steps - 1)
UNION ALL SELECT conv_id, 2.5, 'assistant', '[Compacted] Prior iterations summary:' || chr(10) || string_agg(line, chr(10) ORDER BY step) FROM l GROUP BY 1""")
def compacted_conversations(spark, sf_dir):
    """F38, F36."""
    t = table(spark, sf_dir, "conversations").withColumn("calls_tools", F.col("turn") % 3 == 1)
    return M.compacted(t, 100, keep=1)


@query("""
SELECT event_id, '{"d_value":' || CASE WHEN event_id % 5 = 0 THEN 'null' ELSE (event_id % 8 / 4 + 0.5)::VARCHAR END || ',"at":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '","none":null}' AS json,
  'said' || CASE WHEN event_id % 3 = 0 THEN '' ELSE chr(10) || chr(10) || 'Sources:' || chr(10) || '1. m#s "q"' || chr(10) || '2. n#' || event_id::VARCHAR END AS answer FROM events""")
def json_and_citations(spark, sf_dir):
    """F41, F48."""
    k = F.col("event_id")
    value = F.when(k % 5 == 0, float("nan")).otherwise(k % 8 / 4 + 0.5)
    both = F.array(
        F.struct(F.lit("m").alias("manual_id"), F.lit("s").alias("slug"), F.lit("q").alias("quote")), F.struct(F.lit("n").alias("manual_id"), k.cast("string").alias("slug"), F.lit(None).cast("string").alias("quote")),
    )
    cites = F.when(k % 3 == 0, F.slice(both, 1, 0)).otherwise(both)
    ready = M.json_ready({"d_value": value, "at": F.date_trunc("second", F.col("ts").cast("timestamp")), "none": F.lit(None).cast("string")})
    return table(spark, sf_dir, "events").select("event_id", ready.alias("json"), M.cited(F.lit("said"), cites).alias("answer"))


@query("""
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Given' WHEN 1 THEN 'NMAX-155' WHEN 2 THEN 'STF-900' WHEN 3 THEN 'Bike ' || p_partkey::VARCHAR ELSE 'Generic' END AS model, CASE WHEN p_partkey % 2 = 0 THEN 'brakes' ELSE 'general' END AS subsystem,
  CASE WHEN p_partkey % 3 = 0 THEN 'procedure' ELSE 'section' END AS kind, CASE WHEN p_partkey % 4 = 0 THEN 'Maker' WHEN p_partkey % 4 = 1 THEN 'Maker X' ELSE NULL END AS name FROM part""")
def model_names(spark, sf_dir):
    """F15, F16, F25, F46."""
    k = F.col("p_partkey")
    override = F.when(k % 5 == 0, " Given ")
    body = F.when(k % 5 == 1, "the nmax  155 manual").otherwise("nothing")
    filename = F.when(k % 5 == 2, "a/stf 900 x.pdf").when(k % 5 == 3, F.concat(F.lit("up/Bike_"), k.cast("string"), F.lit(".pdf"))).otherwise("00000000-0000-4000-8000-000000000000.pdf")
    title = F.concat(F.when(k % 2 == 0, "Front Disc Brake, engine").otherwise("Words"), F.when(k % 3 == 0, " removal").otherwise(""))
    maker, model = F.when(k % 4 < 2, "Maker"), F.when(k % 4 == 1, "X").otherwise(" ")
    return table(spark, sf_dir, "part").select(
        "p_partkey", M.model_ladder(override, body, filename, manuals.vehicle_model).alias("model"), M.first_alias(title, {"engine": ["engine"], "brakes": ["brake", "disc brake"]}).alias("subsystem"),
        M.first_pattern(title, [("(?i)removal|install", "procedure"), ("(?i)table", "table")]).alias("kind"), M.canonical_name(maker, model).alias("name"),
    )


@query("""
SELECT doc_id AS id, 1 AS line_no, '| P0' || (100 + doc_id % 40)::VARCHAR || ' | x | ' || CASE WHEN doc_id % 40 < 20 THEN 'card-' || (doc_id % 40)::VARCHAR ELSE 'NOT-INDEXED' END || ' |' AS line FROM documents UNION ALL SELECT doc_id, 2, 'P0300 in prose' FROM documents""")
def code_tables(spark, sf_dir):
    """F45."""
    d = table(spark, sf_dir, "documents")
    code = F.concat(F.lit("| P0"), (100 + F.col("doc_id") % 40).cast("string"), F.lit(" | x |"))
    lines = d.select(F.col("doc_id").alias("id"), F.lit(1).alias("line_no"), code.alias("line")).unionByName(d.select(F.col("doc_id").alias("id"), F.lit(2).alias("line_no"), F.lit("P0300 in prose").alias("line")))
    cards = spark.range(20).select(F.concat(F.lit("P0"), (100 + F.col("id")).cast("string")).alias("code"), F.concat(F.lit("card-"), F.col("id").cast("string")).alias("slug"))
    return M.augmented_code_rows(lines, cards)


@query()
def section_chunks(spark, sf_dir):
    """Chunks of all sections; tests compare the packing with known answers."""
    out = chunking.chunk_sections(manuals.parse_sections(manual_lines(spark, sf_dir)))
    return out.select("id", "chunk_index", "section", "title", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"), "has_image")
