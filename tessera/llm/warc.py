"""Resolution of not-modified revisit records in web archives.

A revisit (a 304 answer) has no body: its content is that of the latest earlier full
response for the same canonical URL, if the validators agree. The headers of the
revisit replace those of the response, but for the ones that describe the body or
the connection, which the stored response keeps.

The as-of join deals records out by ranges of (URL, date, id), so that a URL with
very many records is spread over many tasks. Each range looks back within itself;
what it can't find there comes from the last response of the ranges before it, of
which there is one row per URL and range. Only keys and validators are sorted;
headers are joined afterwards by record id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize

# Header fields that a 304 answer may not change (RFC 9111, 3.2) or that belong to one connection (RFC 9110, 7.6.1).
KEPT_HEADERS = (
    "connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "etag", "keep-alive",
    "proxy-authenticate", "proxy-authentication-info", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)
TRACKING = "utm_[a-z]+|gclid|fbclid|sessionid|phpsessid|jsessionid"


def canonical_url(url: "F.Column") -> "F.Column":
    """Scheme, fragment, user, www and the scheme's default port off; host in lower case; query
    parameters in order, without tracking parameters and empty ones; closing slashes of the path off.
    An address without a scheme loses either default port."""
    trimmed = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme = F.lower(F.regexp_extract(trimmed, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    bare = F.regexp_replace(trimmed, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), "^.*@", ""), "^www[0-9]*[.]", "")
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).when(
        scheme == "", F.regexp_replace(host, ":(80|443)$", "")
    ).otherwise(host)
    rest = F.regexp_replace(bare, "^[^/?]*", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^?]*", 0), "/+$", "")
    given = F.split(F.regexp_replace(rest, "^[^?]*[?]?", ""), "&")
    query = F.array_join(F.array_sort(F.filter(given, lambda p: (p != "") & ~p.rlike(f"^({TRACKING})(=|$)"))), "&")
    return F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def _strong(tag: "F.Column") -> "F.Column":
    """An entity tag without its weak mark: validators of a GET compare weakly."""
    return F.regexp_replace(F.trim(tag), "^[Ww]/", "")


def resolve_revisits(records: DataFrame, ranges: int | None = None) -> DataFrame:
    """(record_id, canonical, status, source_id, headers) for each revisit record.

    ``records``: record_id, kind (response or revisit), url, date, etag,
    last_modified, headers map<string, string> with lower-case names. status is
    ``resolved``, ``mismatch`` (the latest earlier response has another entity tag, or
    none to compare and another modification date), ``unverified`` (no validator on
    both sides) or ``missing`` (no earlier response). Only resolved and unverified
    revisits name their source and its merged headers; others keep their own.

    Earlier means a smaller date, or the same date and a smaller record_id. Rows of
    another kind, or without a url or date, are no source; a revisit without them is
    missing. A record_id is unique; if rows repeat one, a response's smallest headers
    (by their sorted entries) count, and each row of a revisit is answered. An empty
    table gives an empty result; other columns are ignored.
    """
    rows = records.select("record_id", "kind", canonical_url(F.col("url")).alias("canonical"), "date", _strong(F.col("etag")).alias("etag"), "last_modified")
    dated = rows.where(F.col("kind").isin("response", "revisit") & F.col("canonical").isNotNull() & F.col("date").isNotNull() & F.col("record_id").isNotNull())
    parts = ranges or int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dated.repartitionByRange(parts, "canonical", "date", "record_id").withColumn("range", F.spark_partition_id())
    dealt = materialize(dealt, "warc-ranges")
    found = F.when(F.col("kind") == "response", F.struct(F.col("date").alias("at"), F.col("record_id").alias("id"), "etag", "last_modified"))
    # the last response of each URL and range, and then of all ranges before a range
    closing = dealt.where(F.col("kind") == "response").groupBy("canonical", "range").agg(F.max(found).alias("closing"))
    touched = dealt.select("canonical", "range").distinct().join(closing, ["canonical", "range"], "left")
    before = Window.partitionBy("canonical").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = touched.withColumn("carried", F.last("closing", ignorenulls=True).over(before)).select("canonical", "range", "carried")
    back = Window.partitionBy("canonical", "range").orderBy("date", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = dealt.withColumn("near", F.last(found, ignorenulls=True).over(back)).where(F.col("kind") == "revisit")
    asof = near.join(carried, ["canonical", "range"], "left").withColumn("source", F.coalesce("near", "carried"))
    same_tag, same_date = F.col("etag") == F.col("source.etag"), F.col("last_modified") == F.col("source.last_modified")
    status = (
        F.when(F.col("source").isNull(), "missing").when(same_tag, "resolved").when(~same_tag, "mismatch")
        .when(same_date, "resolved").when(~same_date, "mismatch").otherwise("unverified")
    )
    asof = asof.select("record_id", status.alias("status"), F.col("source.id").alias("source_id"))
    asof = asof.withColumn("source_id", F.when(F.col("status").isin("resolved", "unverified"), F.col("source_id")))
    own = records.where(F.col("kind") == "revisit").select("record_id", canonical_url(F.col("url")).alias("canonical"), F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("fresh"))
    stored = records.where((F.col("kind") == "response") & F.col("record_id").isNotNull()).select(F.col("record_id").alias("source_id"), F.array_sort(F.map_entries(F.coalesce("headers", F.create_map().cast("map<string,string>")))).alias("entries"))
    stored = stored.groupBy("source_id").agg(F.map_from_entries(F.min("entries")).alias("stored"))
    joined = own.join(asof.groupBy("record_id").agg(F.min("status").alias("status"), F.min("source_id").alias("source_id")), "record_id", "left").join(stored, "source_id", "left")
    permitted = F.map_filter("fresh", lambda name, _: ~name.isin(*KEPT_HEADERS))
    lasting = F.map_filter("stored", lambda name, _: ~F.map_contains_key(permitted, name))
    merged = F.when(F.col("source_id").isNull(), F.col("fresh")).otherwise(F.map_concat(lasting, permitted))
    return joined.select("record_id", "canonical", F.coalesce("status", F.lit("missing")).alias("status"), "source_id", merged.alias("headers"))


def captures(pages: DataFrame) -> DataFrame:
    """A capture log of ``pages``: a full response and a not-modified revisit for each page.

    Three pages in four are captured under one of eight addresses that the pages of a host
    share, so that a response is often followed by others of its address before its revisit
    comes. Dates are ten times the page_id; the revisit follows 355 later, for one page in
    eleven 5 earlier. One page in five has no entity tag but a modification date, and one
    revisit in thirteen has no validator.
    """
    p = F.col("page_id")
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    shared = F.concat(F.regexp_extract("url", "^[^/]*//[^/?#]*", 0), F.lit("/shared/"), (p % 8).cast("string"), F.lit("?b=1&utm_source=x&a="), (p % 2).cast("string"))
    each = pages.select(
        "page_id", F.when(p % 4 == 0, F.col("url")).otherwise(shared).alias("url"), F.when(p % 5 != 0, tag).alias("tag"),
        F.when(p % 5 == 0, F.concat(F.lit("day "), (p % 3).cast("string"))).alias("modified"), F.length(F.coalesce("html", F.lit(""))).cast("string").alias("n"),
    )
    date = p * 10
    response = each.select(
        (2 * p).alias("record_id"), F.lit("response").alias("kind"), "url", date.alias("date"), F.col("tag").alias("etag"), F.col("modified").alias("last_modified"),
        F.create_map(F.lit("content-length"), "n", F.lit("date"), date.cast("string"), F.lit("server"), F.lit("a")).alias("headers"),
    )
    later = F.when(p % 11 == 0, date - 5).otherwise(date + 355)
    valid = p % 13 != 0
    revisit = each.select(
        (2 * p + 1).alias("record_id"), F.lit("revisit").alias("kind"), "url", later.alias("date"), F.when(valid, F.concat(F.lit("W/"), F.col("tag"))).alias("etag"),
        F.when(valid, F.col("modified")).alias("last_modified"), F.create_map(F.lit("content-length"), F.lit("0"), F.lit("date"), later.cast("string")).alias("headers"),
    )
    return response.unionByName(revisit)
