"""Manuals, layout streams, goldens and reports as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import texts as X

# What a layout's item types are called here, and those that are page furniture.
KINDS = {"title": "title_candidate", "text": "para", "paragraph": "para", "table": "table", "image": "image", "page_header": "page_header"}
SKIPPED = ("page_number", "page_footer")
ITEM = "array<array<struct<type: string, content: string, html: string, image_path: string, bbox: array<double>>>>"


def manual_files(spark: SparkSession, path: str) -> DataFrame:
    """(manual_id, text) of the Markdown files below a folder, but for those of images, uploads, the queue and the index."""
    x = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    x = x.where(~F.col("path").rlike(r"/(images|uploads|\.queue|index)/"))
    return x.select(F.regexp_extract("path", r"([^/]*)\.md$", 1).alias("manual_id"), F.col("value").alias("text"))


def listed_manuals(manuals: DataFrame, model: str | None = None, aliases: dict[str, str] | None = None) -> DataFrame:
    """M5: (manual_id, vehicle_model, title, n_headings) from the fields at the head of manuals(manual_id, text); with ``model`` those of
    it or its alias, dashes, spaces and case aside."""
    x = manuals.withColumn("fields", X.frontmatter_fields(F.col("text")))
    x = x.select("manual_id", F.col("fields")["vehicle_model"].alias("vehicle_model"), F.coalesce(F.col("fields")["title"], "manual_id").alias("title"), F.regexp_count("text", F.lit("(?m)^#{1,6} ")).alias("n_headings"))
    if model is None:
        return x
    bare = lambda c: F.lower(F.regexp_replace(c, r"[\s_-]+", ""))
    wanted = {"".join(ch for ch in m.lower() if ch not in " _-\t") for m in (model, (aliases or {}).get(model, model))}
    return x.where(bare(F.col("vehicle_model")).isin(*sorted(wanted)))


def stream_items(pages: DataFrame) -> DataFrame:
    """(doc_id, idx, page, kind, text, html, image_path, bbox): the items of layouts(doc_id, layout), a JSON list of pages of
    items, numbered through the document; page numbers and footers are left out, unknown types are paragraphs."""
    x = pages.select("doc_id", F.posexplode(F.from_json("layout", ITEM)).alias("page", "items")).select("doc_id", "page", F.posexplode("items").alias("nth", "i"))
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in KINDS.items() for v in kv]), F.col("i.type")), F.lit("para"))
    x = x.where(~F.coalesce(F.col("i.type"), F.lit("")).isin(*SKIPPED))
    idx = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "nth")) - 1
    inside = F.when(~F.col("i.image_path").rlike(r"^/|(^|/)\.\.(/|$)"), F.col("i.image_path"))
    return x.select("doc_id", idx.alias("idx"), (F.col("page") + 1).alias("page"), kind.alias("kind"), F.trim(F.coalesce("i.content", F.lit(""))).alias("text"), F.coalesce("i.html", F.lit("")).alias("html"), inside.alias("image_path"), F.col("i.bbox").alias("bbox"))


def region_lines(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """lines(doc_id, page, x, y, line) within regions(doc_id, page, region, x0, y0, x1, y1) of their page, edges included."""
    return lines.join(regions, ["doc_id", "page"]).where("x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1").select("doc_id", "page", "region", "x", "y", "line")


def goldens(files: DataFrame) -> DataFrame:
    """(path, line_no, tier, entry) of files(path, body) with a JSON object a line; blank and malformed lines are left out. The tier
    is that of the folder, ``candidates`` or ``locked``."""
    x = files.select("path", F.posexplode(F.split("body", "\r?\n")).alias("p", "line"))
    x = x.where((F.trim("line") != "") & F.try_parse_json("line").isNotNull() & F.trim("line").startswith("{"))
    tier = F.when(F.col("path").rlike("(^|/)locked/"), "locked").when(F.col("path").rlike("(^|/)candidates/"), "candidate").otherwise("other")
    return x.select("path", (F.col("p") + 1).alias("line_no"), tier.alias("tier"), F.col("line").alias("entry"))


def report_records(reports: DataFrame) -> DataFrame:
    """(report, id, lane, score) of the records in reports(report, body); a record without a grade has a null score."""
    shape = "struct<records: array<struct<entry: struct<id: string, lane: string>, grade: struct<overall: double>>>>"
    r = F.explode(F.from_json("body", shape)["records"]).alias("r")
    return reports.select("report", r).select("report", "r.entry.id", "r.entry.lane", F.col("r.grade.overall").alias("score"))


def node_texts(nodes: DataFrame, content: DataFrame) -> DataFrame:
    """nodes(manual_id, node_id, line_start, line_end) of a stored index with their text, the half-open range of content(manual_id,
    line_no, line), numbered from 0."""
    x = content.join(nodes, "manual_id").where("line_no >= line_start AND line_no < line_end")
    rows = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return x.groupBy("manual_id", "node_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("text"))


def session_files(sessions: DataFrame, files: DataFrame) -> DataFrame:
    """sessions(session_id, file_path) with the body of files(file_path, body); a session without a file is left out."""
    return sessions.join(files, "file_path").select("session_id", "body")


def snapshots(long: DataFrame) -> DataFrame:
    """(session_id, row_id, pids, supported, codes, vin): a row's numeric signals as a map, their names in order, its trouble codes,
    each once, and the vehicle number if there is one."""
    number = F.when(F.col("value").isNotNull(), F.struct("signal", "value"))
    codes = F.flatten(F.collect_list(F.when(F.col("signal").isin("GET_DTC", "GET_CURRENT_DTC"), F.regexp_extract_all("raw", F.lit("[PCBU][0-9A-Fa-f]{4}"), F.lit(0)))))
    x = long.groupBy("session_id", "row_id").agg(F.map_from_entries(F.collect_list(number)).alias("pids"), F.array_sort(F.array_distinct(F.transform(codes, lambda c: F.upper(c)))).alias("codes"), F.max(F.when(F.col("signal") == "VIN", X.vin(F.col("raw")))).alias("vin"))
    return x.select("session_id", "row_id", "pids", F.array_sort(F.map_keys("pids")).alias("supported"), "codes", "vin")
