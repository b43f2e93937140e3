"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ann, bpe, chat, extraction, packing, quality, resampling, runindex, runs, simhash, topk, toxicity, warc
from tessera.llm.common import table

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT -1L AS conv_id, turn, role, '{probe}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    formatted = chat.format_conversations(rows.unionByName(more))
    return chat.read_back(formatted, in_order=True)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op2_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex64(F.col("fp")).alias("fingerprint"), "component_id")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op5_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(warc.captures(table(spark, sf_dir, "pages")))
    header = lambda name: F.col("headers")[name]
    return found.select(
        "record_id", "canonical", "status", "source_id", header("content-length").alias("content_length"), header("date").alias("date"), header("server").alias("server")
    )


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = extraction.extract(table(spark, sf_dir, "pages"))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.find_runs(runs.planted(table(spark, sf_dir, "documents"))))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runindex.remove_repeats(table(spark, sf_dir, "documents"))
    n_removed = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    return found.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), "kept_sha256")


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_format, op2_toxicity, op3_simhash, op4_topk, op5_quality, op6_warc_revisits, op7_ann, op8_packing, op9_extraction, op10_bpe,
        op11_resampling, op12_runs, op13_suffix_dedup,
    )
}

_CONTROLS = r"<\|im_start\|>|<\|im_sep\|>|<\|im_end\|>|<s>|</s>|\[INST\]|\[/INST\]|<\|endoftext\|>|<\|system\|>|<\|user\|>|<\|assistant\|>|\\"
_FOLLOWS = "('start','system'),('start','user'),('system','user'),('user','assistant'),('assistant','user')"

ORACLE_SQL = {
    "op1_chat_format": f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), o AS (
  SELECT *, row_number() OVER w AS nth, coalesce(lag(role) OVER w, 'start') AS before
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(32 + length(role) + length(text) + len(regexp_extract_all(role, '{_CONTROLS}')) + len(regexp_extract_all(text, '{_CONTROLS}')))::BIGINT AS formatted_chars,
  bool_and((before, role) IN ({_FOLLOWS})) AND arg_max(role, nth) = 'assistant' AS valid
FROM o GROUP BY conv_id""",
    "op4_topk": """
WITH c AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND NOT coalesce(list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x))), false)
), q AS (SELECT vec_id AS query_id, min(v) AS w FROM c WHERE vec_id % 100 = 0 GROUP BY 1),
s AS (
  SELECT DISTINCT query_id, vec_id, CAST(coalesce(list_sum(list_transform(range(1, least(len(v), len(w)) + 1), lambda j: v[j] * w[j])), 0) AS BIGINT) AS score
  FROM q JOIN c ON query_id <> vec_id
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10""",
    "op6_warc_revisits": r"""
WITH e AS (
  SELECT page_id AS p, length(coalesce(html, '')) AS n, CASE WHEN page_id % 5 <> 0 THEN '"' || md5(coalesce(html, '')) || '"' END AS tag,
    CASE WHEN page_id % 5 = 0 THEN 'day ' || (page_id % 3)::VARCHAR END AS modified,
    CASE WHEN page_id % 4 = 0 THEN url ELSE regexp_extract(url, '^[^/]*//[^/?#]*') || '/shared/' || (page_id % 8)::VARCHAR || '?b=1&utm_source=x&a=' || (page_id % 2)::VARCHAR END AS url
  FROM pages
), t AS (SELECT *, regexp_replace(trim(url), '#.*$', '') AS trimmed FROM e),
b AS (SELECT *, lower(regexp_extract(trimmed, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, regexp_replace(trimmed, '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM t),
h AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^.*@', ''), '^www[0-9]*[.]', ''),
      CASE scheme WHEN 'http' THEN ':80$' WHEN 'https' THEN ':443$' WHEN '' THEN ':(80|443)$' ELSE '^$' END, '') AS host,
    regexp_replace(regexp_extract(regexp_replace(bare, '^[^/?]*', ''), '^[^?]*'), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_replace(regexp_replace(bare, '^[^/?]*', ''), '^[^?]*[?]?', ''), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|gclid|fbclid|sessionid|phpsessid|jsessionid)(=|$)'))), '&') AS query
  FROM b
), k AS (SELECT p, n, tag, modified, host || path || CASE WHEN query = '' THEN '' ELSE '?' || query END AS canonical FROM h),
r AS (
  SELECT canonical, 2 * p AS id, 10 * p AS dated, true AS full_, tag, modified, n FROM k
  UNION ALL SELECT canonical, 2 * p + 1, CASE WHEN p % 11 = 0 THEN 10 * p - 5 ELSE 10 * p + 355 END, false,
    CASE WHEN p % 13 <> 0 THEN tag END, CASE WHEN p % 13 <> 0 THEN modified END, n FROM k
), f AS (
  SELECT *, last_value(CASE WHEN full_ THEN {'id': id, 'tag': tag, 'modified': modified, 'n': n} END IGNORE NULLS) OVER (
    PARTITION BY canonical ORDER BY dated, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM r
), x AS (
  SELECT *, CASE WHEN s IS NULL THEN 'missing' WHEN tag = s.tag THEN 'resolved' WHEN tag <> s.tag THEN 'mismatch'
    WHEN modified = s.modified THEN 'resolved' WHEN modified <> s.modified THEN 'mismatch' ELSE 'unverified' END AS status FROM f WHERE NOT full_
)
SELECT id AS record_id, canonical, status, CASE WHEN status IN ('resolved', 'unverified') THEN s.id END AS source_id,
  CASE WHEN status IN ('resolved', 'unverified') THEN s.n::VARCHAR ELSE '0' END AS content_length, dated::VARCHAR AS date,
  CASE WHEN status IN ('resolved', 'unverified') THEN 'a' END AS server
FROM x""",
    # crc32 bytewise: the sum is the exclusive-or of each byte's own share, by the number of bytes after it, and that of as many zero bytes
    "op11_resampling": r"""
WITH RECURSIVE t0 AS (
  SELECT b, list_reduce(list_concat([b::BIGINT], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(b)
), words AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), f AS (
  SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS x FROM words
), g AS (SELECT x, strlen(x) AS n, hex(encode(x)) AS h FROM f GROUP BY x),
z AS (
  SELECT 0 AS k, 4294967295::BIGINT AS c UNION ALL
  SELECT k + 1, xor(z.c >> 8, t0.c) FROM z JOIN t0 ON t0.b = z.c & 255 WHERE k < (SELECT max(n) FROM g)
), t AS (
  SELECT 0 AS k, b, c FROM t0 UNION ALL
  SELECT k + 1, t.b, xor(t.c >> 8, t0.c) FROM t JOIN t0 ON t0.b = t.c & 255 WHERE k < (SELECT max(n) FROM g)
), bytes AS (SELECT x, n, unnest(range(n)) AS i, h FROM g),
sums AS (
  SELECT x, any_value(n) AS n, bit_xor(t.c) AS c FROM bytes JOIN t ON t.k = n - 1 - i AND t.b = ('0x' || substr(h, 2 * i + 1, 2))::INT GROUP BY x
), bucket AS (SELECT x, xor(xor(s.c, z.c), 4294967295) % 10000 AS bucket FROM sums s JOIN z ON z.k = s.n),
counts AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM f JOIN bucket USING (x) GROUP BY bucket),
total AS (SELECT coalesce(sum(s), 0)::DOUBLE + 10000 AS s_all, coalesce(sum(t), 0)::DOUBLE + 10000 AS t_all FROM counts),
gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * s_all / ((s + 1)::DOUBLE * t_all)))::BIGINT AS gain FROM counts, total),
weight AS (SELECT id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM f JOIN bucket USING (x) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY id),
scored AS (
  SELECT w.id AS doc_id, len(w) >= 20 AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || w.id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM words w LEFT JOIN weight USING (id) WHERE side = 'd'
), ranked AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS nth, count(*) FILTER (able) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND nth <= 5 * n // 100 THEN nth END AS rank FROM ranked""",
}
