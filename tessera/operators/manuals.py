"""Markdown manuals as lines: headings, sections, tables of contents, search and node resolution.

All take lines(id, line_no, line), numbered from 1 within a document. A heading's place in
its tree follows from windows over the document's headings: for each of the six levels the
last heading before, and the next one after.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scalars as S

LEVELS = range(1, 7)
# Titles that are no headings: numbered steps, warning banners, tokens of flow charts.
NO_HEADING = (r"^\s*\d+\.\s+\S{1,40}:?\s*$", r"^\s*(?:注\s*意|警\s*告|註)(?:\s+[A-Z]{2,4}\d\w*)?\s*$", r"^\s*(?:OK\s*↓|[▲▼\s]+)\s*$")
LONGEST_HEADING = 150
EMPTY_ELEMENT = r"(?i)<([a-zA-Z][a-zA-Z0-9]*)\b[^>]*>\s*</\1\s*>"
IMAGE = r"!\[[^\]]*\]\([^)]+\)"
PAGE_BREAK = r"^(?:<!--\s*page:\s*\d+\s*-->|\{\d+\}-{4,})$"
VISION = r"^\*Vision description:"
ANCHORED_TITLE = r'^(?:<span id="page-[^"]+"></span>\s*)+([^<>|]+?)\s*$'
# Vehicle models, in the order in which they are tried; the first keeps its digits only.
MODELS = (r"(?i)\bSTF[-\s]?\d{3,4}\b", r"(?i)\bMWS[-\s]?\d{2,4}[-\s]?[A-Z]?\b", r"(?i)\bTRICITY\s*\d{2,3}\b", r"(?i)\bNMAX\s*\d{2,3}\b", r"(?i)\bXMAX\s*\d{2,3}\b")

MODEL_WORDS = ("stf", "mws", "tricity", "nmax", "xmax")  # one of which each of MODELS needs


def by_line() -> Window:
    return Window.partitionBy("id").orderBy("line_no")


def without_empty_elements(text: Column) -> Column:
    """HTML elements around white space only are dropped, and those that this leaves empty."""
    return F.regexp_replace(F.regexp_replace(text, EMPTY_ELEMENT, ""), EMPTY_ELEMENT, "")


def clean_title(raw: Column) -> Column:
    """no empty elements, no emphasis around the title, single spaces, at most 2,000 characters."""
    bare = F.regexp_replace(F.regexp_replace(without_empty_elements(raw), r"^\s*[*_]+", ""), r"[*_]+\s*$", "")
    return F.substring(F.trim(F.regexp_replace(bare, r"\s+", " ")), 1, 2000)


def is_real_heading(title: Column) -> Column:
    """P15."""
    text = F.trim(title)
    return (text != "") & (F.length(text) <= LONGEST_HEADING) & reduce(lambda a, b: a & b, (~text.rlike(p) for p in NO_HEADING))


def vehicle_model(text: Column) -> Column:
    """the first model that a text names, in capitals with single dashes, or Generic."""
    plain = lambda p: F.upper(F.regexp_replace(F.regexp_extract(text, p, 0), r"[-\s]+", "-"))
    # most texts name none: that they lack all the words is cheaper to see than that no pattern fits
    some = reduce(lambda a, b: a | b, (F.contains(F.lower(text), F.lit(w)) for w in MODEL_WORDS))
    found = [F.when(text.rlike(p), F.concat(F.lit("STF-"), F.regexp_extract(plain(p), r"\d{2,4}", 0)) if not k else plain(p)) for k, p in enumerate(MODELS)]
    return F.when(some, F.coalesce(*found, F.lit("Generic"))).otherwise("Generic")


def promoted(line: Column) -> Column:
    """a line of page anchors and a short bare title becomes a heading of level three."""
    title = F.trim(F.regexp_extract(line, ANCHORED_TITLE, 1))
    odd = [r"^\d+\.\s+\S{1,40}:?\s*$", NO_HEADING[1], r"^[-*•!\[(]", r"^[a-zA-Z][.、]", '"', "。$"]
    fits = line.rlike(ANCHORED_TITLE) & (title != "") & (F.length(title) <= 40) & title.rlike(r"[\p{L}\p{N}_]") & ~reduce(lambda a, b: a | b, (title.rlike(p) for p in odd))
    return F.when(fits, F.concat(F.lit("### "), title)).otherwise(line)


def heading_title(line: Column) -> Column:
    """The title of a line that is a real heading, else null."""
    title = F.trim(F.regexp_extract(line, r"^#{1,6}\s+(.+)$", 1))
    return F.when(line.rlike(r"^#{1,6}\s+.+$") & is_real_heading(title), title)


def heading_level(line: Column) -> Column:
    return F.length(F.regexp_extract(line, "^#+", 0))


def headings(lines: DataFrame) -> DataFrame:
    """(id, line_no, level, title): the real headings."""
    x = lines.where(F.col("line").rlike(r"^#{1,6}\s+.+$")).withColumn("title", heading_title(F.col("line"))).where("title IS NOT NULL")
    return x.select("id", "line_no", heading_level(F.col("line")).alias("level"), "title")


def caption_stubs(lines: DataFrame) -> DataFrame:
    """(id, line_no) of headings over a figure only: no deeper heading follows, and the lines up to
    the next heading hold an image, maybe page breaks and descriptions of it, and nothing else."""
    x = lines.join(headings(lines), ["id", "line_no"], "left")
    text = F.trim(without_empty_elements(F.col("line")))
    opens, ends = text.rlike(VISION), text.endswith("*")
    back = by_line().rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("text", text).withColumn("head", F.last(F.when(F.col("level").isNotNull(), F.col("line_no")), ignorenulls=True).over(by_line()))
    # a description goes on until a line that ends with its mark
    x = x.withColumn("open_at", F.last(F.when(opens & ~ends, F.col("line_no")), ignorenulls=True).over(back)).withColumn("end_at", F.last(F.when(ends, F.col("line_no")), ignorenulls=True).over(back))
    told = (F.col("open_at") > F.coalesce("head", F.lit(0))) & (F.col("open_at") > F.coalesce("end_at", F.lit(0)))
    image = F.regexp_count("text", F.lit(IMAGE)) > 0
    only_image = image & (F.trim(F.regexp_replace("text", IMAGE, "")) == "")
    plain = (F.col("text") == "") | F.coalesce(told, F.lit(False)) | F.col("text").rlike(PAGE_BREAK) | opens | only_image
    body = x.where("head IS NOT NULL AND level IS NULL").withColumn("plain", plain).withColumn("shows", only_image & ~F.coalesce(told, F.lit(False)))
    bodies = body.groupBy("id", "head").agg(F.min("plain").alias("plain"), F.max("shows").alias("shows"))
    nodes = headings(lines).withColumn("next_level", F.lead("level").over(by_line()))
    leaf = nodes.where(F.coalesce(F.col("next_level") <= F.col("level"), F.lit(True)))
    return leaf.join(bodies.where("plain AND shows").select("id", F.col("head").alias("line_no")), ["id", "line_no"]).select("id", "line_no")


def sections(lines: DataFrame) -> DataFrame:
    """(id, line_no, level, title, slug, parent_line, end_line, subtree_end, nth) of all
    headings but caption stubs. ``end_line`` is the line after the section's last, up to the next heading
    of any level; ``subtree_end`` the same with its subsections. Repeated slugs get -2, -3 and so on."""
    heads = headings(lines).join(caption_stubs(lines), ["id", "line_no"], "left_anti")
    last = lines.groupBy("id").agg((F.max("line_no") + 1).alias("eof"))
    x = heads.join(last, "id").withColumn("base", S.slug(F.col("title")))
    again = F.row_number().over(Window.partitionBy("id", "base").orderBy("line_no"))
    back = by_line().rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("id").orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, -1)
    before = [F.last(F.when(F.col("level") == k, F.col("line_no")), ignorenulls=True).over(back) for k in LEVELS]
    after = [F.last(F.when(F.col("level") == k, F.struct("line_no", "nth")), ignorenulls=True).over(ahead) for k in LEVELS]
    x = x.withColumn("nth", F.row_number().over(by_line())).withColumn("again", again).withColumn("before", F.array(*before)).withColumn("after", F.array(*after))
    up = F.array_max(F.slice("before", 1, F.col("level") - 1))
    down = F.array_min(F.filter(F.slice("after", 1, F.col("level")), lambda s: s.isNotNull()))
    total = F.count("*").over(Window.partitionBy("id"))
    return x.select(
        "id", "line_no", "level", "title", F.when(F.col("again") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", "again")).alias("slug"), up.alias("parent_line"),
        F.coalesce(F.lead("line_no").over(by_line()), F.col("eof")).alias("end_line"), F.coalesce(down["line_no"], F.col("eof")).alias("subtree_end"),
        (F.coalesce(down["nth"], total + 1) - F.col("nth") - 1).alias("n_below"), F.col("nth"),
    )


def table_of_contents(sections_: DataFrame, max_depth: int = 3) -> DataFrame:
    """M2: (id, nth, entry, n_below): indented titles down to a level, each with its slug and how many headings are below."""
    entry = F.concat(F.repeat(F.lit("  "), F.col("level") - 1), F.lit("- "), F.col("title"), F.lit(" [#"), F.col("slug"), F.lit("]"))
    return sections_.where(F.col("level") <= max_depth).select("id", "nth", entry.alias("entry"), "n_below")


def section_texts(lines: DataFrame, sections_: DataFrame, subsections: bool = False) -> DataFrame:
    """M3: (id, slug, text) of each section of ``sections_``, heading included; without its subsections every
    line is looked up once, as the last heading before it. Empty elements are dropped."""
    if not subsections:
        x = with_section(lines, sections_).where("slug IS NOT NULL")
    else:
        s = sections_.select("id", F.col("line_no").alias("first"), "subtree_end", "slug")
        x = lines.join(s, "id").where("line_no >= first AND line_no < subtree_end")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda r: r["line"]), "\n")
    return x.groupBy("id", "slug").agg(without_empty_elements(F.regexp_replace(body, r"\s+$", "")).alias("text"))


def with_section(lines: DataFrame, sections_: DataFrame) -> DataFrame:
    """Each line with the slug of the section it is in, null before the first heading."""
    heads = sections_.select("id", "line_no", "slug")
    return lines.join(heads, ["id", "line_no"], "left").withColumn("slug", F.last("slug", ignorenulls=True).over(by_line()))


def search(lines: DataFrame, sections_: DataFrame, phrase: str, most: int = 20, preview: int = 110) -> DataFrame:
    """(id, nth, line_no, slug, preview): a document's first ``most`` lines that hold a phrase, case
    aside, with their section; lines with dotted leaders or cross-references come after all others."""
    hits = with_section(lines, sections_).where(F.contains(F.lower("line"), F.lit(phrase.lower())))
    low = F.col("line").rlike(r"\.{3,}") | F.contains("line", F.lit("參閱"))
    nth = F.row_number().over(Window.partitionBy("id").orderBy(low, "line_no"))
    return hits.withColumn("nth", nth).where(F.col("nth") <= most).select("id", "nth", "line_no", "slug", F.substring(F.trim("line"), 1, preview).alias("preview"))


def parse_sections(lines: DataFrame) -> DataFrame:
    """(id, nth, title, level, body, vehicle_model, codes): a document's sections, the text before its
    first heading as one of level 0. A section without a model of its own has the document's."""
    # whether a line is a heading is seen from the line alone, so the lines are dealt out by id once
    x = lines.select("id", "line_no", "line", heading_title(F.col("line")).alias("head"))
    x = x.withColumn("level", F.when(F.col("head").isNotNull(), heading_level(F.col("line")))).withColumn("title", clean_title(F.col("head")))
    x = x.withColumn("nth", F.count("level").over(by_line()).cast("int"))
    rows = F.array_sort(F.collect_list(F.when(F.col("level").isNull(), F.struct("line_no", "line"))))
    body = F.trim(F.array_join(F.transform(rows, lambda r: r["line"]), "\n"), F.lit(" \t\r\n"))
    parts = x.groupBy("id", "nth").agg(F.max("title").alias("title"), F.max("level").alias("level"), without_empty_elements(body).alias("body"))
    parts = parts.where("nth > 0 OR body <> ''").withColumn("whole", F.concat_ws(" ", "title", "body")).withColumn("own", vehicle_model(F.col("whole")))
    models = lines.withColumn("own", vehicle_model(F.col("line"))).where("own <> 'Generic'").groupBy("id").agg(F.min_by("own", F.struct("line_no")).alias("doc_model"))
    codes = F.array_sort(F.array_distinct(F.regexp_extract_all("whole", F.lit(r"\b[PCBU]\d{4}\b"), F.lit(0))))
    model = F.when(F.col("own") != "Generic", F.col("own")).otherwise(F.coalesce("doc_model", F.lit("Generic")))
    out = parts.join(models, "id", "left")
    return out.select("id", "nth", F.coalesce("title", F.lit("Introduction")).alias("title"), F.coalesce("level", F.lit(0)).alias("level"), "body", model.alias("vehicle_model"), codes.alias("codes"))


def bigrams(text: Column) -> Column:
    return F.when(F.length(text) < 2, F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda k: F.substring(text, k, F.lit(2))))
    )


def resolve(requests: DataFrame, nodes: DataFrame, most: int = 10_000) -> DataFrame:
    """(request, how, node_ids): nodes(node_id, names array) that each request(request) names. The
    first of these that finds any counts: the id, the exact name or its slug, a part of a name or
    slug, the longest run of CJK letters as one of these, and at most five names that share three
    tenths or more of their pairs of letters, the most alike first. ``requests`` is a stated set of at most ``most``, as each is compared with every name; more raise an error."""
    if requests.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} requests")
    asked = requests.select("request", F.trim("request").alias("q"))
    runs = F.regexp_extract_all("q", F.lit(r"[⺀-鿿豈-﫿]{2,}"), F.lit(0))
    longest = F.aggregate(runs, F.lit(""), lambda a, r: F.when(F.length(r) > F.length(a), r).otherwise(a))
    tail = asked.withColumn("q", longest).where("q <> ''")
    both = asked.withColumn("step", F.lit(0)).unionByName(tail.withColumn("step", F.lit(10))).withColumn("s", S.slug(F.col("q")))
    named = nodes.select("node_id", F.explode("names").alias("name")).withColumn("slug", S.slug(F.col("name")))
    x = named.join(F.broadcast(both))  # counted above
    exact = (F.col("q") == F.col("name")) | (F.col("s") == F.col("slug"))
    part = F.contains("name", F.col("q")) | ((F.col("s") != "") & F.contains("slug", F.col("s")))
    rank = F.when(F.col("q") == F.col("node_id"), 0).when(exact, 1).when(part, 2)
    found = x.withColumn("how", rank + F.col("step")).where("how IS NOT NULL").select("request", "how", "node_id", F.lit(0.0).alias("apart"))
    shared = F.size(F.array_intersect(bigrams(F.col("s")), bigrams(F.col("slug")))) / F.size(F.array_union(bigrams(F.col("s")), bigrams(F.col("slug"))))
    alike = x.where((F.col("step") == 0) & (F.length("s") > 1) & (F.length("slug") > 1)).withColumn("share", shared).where("share >= 0.3")
    alike = alike.groupBy("request", "node_id").agg((-F.max("share")).alias("apart"))
    nearest = F.row_number().over(Window.partitionBy("request").orderBy("apart", "node_id"))
    alike = alike.withColumn("n", nearest).where("n <= 5").select("request", F.lit(20).alias("how"), "node_id", "apart")
    each = found.unionByName(alike)
    best = each.withColumn("least", F.min("how").over(Window.partitionBy("request"))).where("how = least")
    ids = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("apart", "node_id"))), lambda r: r["node_id"]))
    got = best.groupBy("request", "how").agg(ids.alias("node_ids"))
    return requests.select("request").distinct().join(got, "request", "left")


def carried_forward(pages: DataFrame, default: str = "front matter") -> DataFrame:
    """pages(id, page, title) where a page without a title has that of the page before."""
    order = Window.partitionBy("id").orderBy("page")
    return pages.withColumn("title", F.coalesce(F.last("title", ignorenulls=True).over(order), F.lit(default)))


def chapter_runs(pages: DataFrame) -> DataFrame:
    """(id, run, title, first_page, last_page) of neighbouring pages with one title."""
    order = Window.partitionBy("id").orderBy("page")
    new = F.coalesce((~F.col("title").eqNullSafe(F.lag("title").over(order))).cast("int"), F.lit(1))
    x = pages.withColumn("new", new).withColumn("run", F.sum("new").over(order))
    return x.groupBy("id", "run", "title").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"))


def narrowest_span(points: DataFrame, spans: DataFrame, keys: list[str], bucket: int) -> DataFrame:
    """points(keys, at) with the narrowest half-open span(keys, start, end, span_id) around each, null if
    none; the smaller id on a tie. Spans meet points in the buckets that they reach into."""
    reached = F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("end") - 1) / bucket)))
    near = spans.where("start < end").withColumn("bucket", reached)
    x = points.withColumn("bucket", F.floor(F.col("at") / bucket)).join(near, [*keys, "bucket"], "left")
    inside = (F.col("at") >= F.col("start")) & (F.col("at") < F.col("end"))
    best = F.min_by(F.when(inside, F.col("span_id")), F.when(inside, F.struct(F.col("end") - F.col("start"), F.col("span_id"))))
    return x.groupBy(*[c for c in points.columns]).agg(best.alias("span_id"))
