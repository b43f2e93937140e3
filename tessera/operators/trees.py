"""Nested trees of manuals, made of their items alone, and cards of the trouble codes in them.

Items are (manual_id, idx, page, kind, text, html). A chapter is a run of pages under one running header; nodes
begin at titles, at blocks of trouble codes without a title and at short paragraphs that are titles;
causes go below the symptom before them. Items meet windows by manual and chapter only; what is nested and
folded in one task are the nodes of a manual, without their texts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import texts as X
from tessera.operators.indexing import LEAST_CHARS, suffixed
from tessera.operators.scans import deepest_span

# fixed values: what a title must not be, what opens a node without one, what tables say about a node
NOISE_TITLES = (r"^\s*(?:注\s*意|警\s*告|註)(?:\s+[A-Z]{2,4}\d\w*)?\s*$", r"^\s*(?:OK\s*↓|[▲▼\s]+)\s*$", r"^\s*\d+\.\s+\S{1,40}:?\s*$", r"^\s*[•·]", r"。\s*$")
LEAST_TITLE, MOST_TITLE, MOST_PROMOTED = 2, 60, 24
TASK_ENDS = ("的釋放", "的調整", "的檢查", "的更換", "的清潔", "的拆卸", "的安裝", "的分解", "的組裝", "的測量")
CODE_BLOCK = "故障代碼編號"
CODE_TABLE = "故障防護系統"
TABLE_TYPES = (("故障防護系統", "specification"), ("工作/拆卸零件", "parts"), ("鎖緊扭力", "specification"))
TROUBLESHOOTING = "故障排除"
FRONT_MATTER = "前言"

_CODE = r"(?i)" + CODE_BLOCK + r"(?U:\s*)([PCBU]\d[0-9A-F]{3})"


@dataclass(frozen=True)
class Vocabulary:
    """Subsystems with their aliases, node types with the patterns of their titles, in order, and titles of causes."""

    subsystems: dict[str, tuple] = field(default_factory=dict)
    node_types: dict[str, tuple] = field(default_factory=dict)
    causes: tuple = ()

    @staticmethod
    def _first(pairs: list, title: Column) -> Column:
        if not pairs:
            return F.lit(None).cast("string")
        rows = F.array(*[F.struct(F.lit(p).alias("pattern"), F.lit(n).alias("name")) for p, n in pairs])
        return F.get(F.filter(rows, lambda r: F.contains(title, r["pattern"])), F.lit(0))["name"]

    def subsystem(self, title: Column) -> Column:
        """The subsystem with the longest alias in a title, the first of them on a tie; null if none."""
        pairs = [(a, n) for n, aliases in self.subsystems.items() for a in aliases if a]
        return self._first(sorted(pairs, key=lambda p: -len(p[0])), title)

    def node_type(self, title: Column) -> Column:
        """The first type that has a pattern in a title, else ``description``."""
        return F.coalesce(self._first([(p, n) for n, patterns in self.node_types.items() for p in patterns if p], title), F.lit("description"))


def stripped(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def noise_title(title: Column) -> Column:
    """Whether a title is none: too short or long, a banner, an arrow, a numbered step, a bullet or a sentence; null is."""
    t = stripped(title)
    odd = (F.length(t) < LEAST_TITLE) | (F.length(t) > MOST_TITLE)
    for pattern in NOISE_TITLES:
        odd = odd | t.rlike("(?U)" + pattern)
    return odd


def promotable(text: Column) -> Column:
    """Whether a paragraph is a title: short, with a task at its end, no sentence and no noise."""
    t = stripped(text)
    return (F.length(t) <= MOST_PROMOTED) & t.rlike("(?:" + "|".join(TASK_ENDS) + ")$") & ~t.rlike("[。,，]") & ~noise_title(t)


def _headers(text: Column) -> Column:
    """A header that names a section: two CJK letters, or two words with eight letters together."""
    words = F.regexp_extract_all(text, F.lit(r"([A-Za-z]{2,})"), F.lit(1))
    letters = F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w))
    cjk = F.size(F.regexp_extract_all(text, F.lit(r"([⺀-鿿豈-﫿])"), F.lit(1)))
    return (cjk >= 2) | ((F.size(words) >= 2) & (letters >= 8))


def with_chapters(items: DataFrame, default: str = FRONT_MATTER) -> DataFrame:
    """Items with the ``chapter`` of their page and its number ``run``: a page's first header that names a section,
    carried to pages without one; neighbouring pages with one chapter are one run."""
    t = stripped(F.col("text"))
    named = (F.col("kind") == "page_header") & _headers(t)
    pages = items.groupBy("manual_id", "page").agg(F.min_by(F.when(named, t), F.when(named, F.col("idx"))).alias("own"))
    order = Window.partitionBy("manual_id").orderBy("page")
    pages = pages.withColumn("chapter", F.coalesce(F.last("own", ignorenulls=True).over(order), F.lit(default)))
    new = F.coalesce((F.col("chapter") != F.lag("chapter").over(order)).cast("int"), F.lit(1))
    pages = pages.withColumn("new", new).withColumn("run", F.sum("new").over(order).cast("int"))
    return items.join(pages.select("manual_id", "page", "run", "chapter"), ["manual_id", "page"])


def with_openings(items: DataFrame) -> DataFrame:
    """Items with ``opens``, the nodes that begin there as (title, made): their own title, a paragraph that is one, and a block of a
    trouble code, where it comes first and no title of the manual names the code."""
    title = (F.col("kind") == "title_candidate") & ~noise_title(F.col("text"))
    payload = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.coalesce("html", F.lit("")))
    code = F.nullif(F.upper(F.regexp_extract(payload, _CODE, 1)), F.lit(""))
    titled = items.where(title).select("manual_id", F.explode(F.regexp_extract_all("text", F.lit(_CODE), F.lit(1))).alias("code")).select("manual_id", F.upper("code").alias("code")).distinct()
    blocks = items.where(F.col("kind").isin("para", "table")).select("manual_id", "idx", code.alias("code")).where("code IS NOT NULL")
    blocks = blocks.groupBy("manual_id", "code").agg(F.min("idx").alias("idx")).join(titled, ["manual_id", "code"], "left_anti")
    node = lambda when, t, made: F.when(when, F.struct(t.alias("title"), F.lit(made).alias("made")))
    opens = F.array_compact(
        F.array(
            node(title, stripped(F.col("text")), False), node((F.col("kind") == "para") & promotable(F.col("text")), stripped(F.col("text")), True),
            node(F.col("_code").isNotNull(), F.concat(F.lit(CODE_BLOCK + " "), F.col("_code")), True),
        )
    )
    return items.join(blocks.withColumnRenamed("code", "_code"), ["manual_id", "idx"], "left").withColumn("opens", opens).drop("_code")


NODE = (
    "manual_id string, node_id string, parent_id string, depth int, title string, aliases array<string>, node_type string, subsystem string, "
    "span_start long, span_end long, page_first long, page_last long, chapter string"
)


def _take(into: dict, node: dict) -> None:
    """A thin node's title and extent go into another node."""
    into["aliases"] += [node["title"], *node["aliases"]]
    into["chars"] += node["chars"]
    for low, high in (("span_start", "span_end"), ("page_first", "page_last")):
        into[low], into[high] = min(into[low], node[low]), max(into[high], node[high])


def _folded(siblings: list, parent: dict | None, least: int) -> list:
    """Siblings without thin ones: each goes into the next, the last into the one before, an only one into its parent."""
    kept: list = []
    waiting = None
    for node in siblings:
        node["kids"] = _folded(node["kids"], node, least)
        if waiting:
            _take(node, waiting)
        waiting = node if not (node["kids"] or node["image"] or node["chars"] >= least) else None
        if not waiting:
            kept.append(node)
    if waiting and kept:
        _take(kept[-1], waiting)
    elif waiting and parent:
        parent["aliases"] += [waiting["title"], *waiting["aliases"]]
    elif waiting:
        kept.append(waiting)
    return kept


def _nested(table: pa.Table, least: int) -> pa.Table:
    """The tree of one manual's nodes, in order of run and nth: 0 is a chapter, ``below`` hangs under the last symptom."""
    rows = table.sort_by([("run", "ascending"), ("nth", "ascending")]).to_pylist()
    roots: list = []
    for node, node["node_id"] in zip(rows, suffixed([n["base"] for n in rows])):
        node["kids"], node["aliases"] = [], []
        if node["nth"] == 0:
            roots.append(node)
            symptom = None
        elif node["below"] and symptom:
            symptom["kids"].append(node)
            symptom["span_end"], symptom["page_last"] = node["span_end"], max(symptom["page_last"], node["page_last"])
            symptom["chars"] += node["chars"]
        else:
            roots[-1]["kids"].append(node)
            symptom = symptom if node["below"] else node

    def listed(nodes: list, parent_id: str | None, depth: int):
        for n in nodes:
            yield {**n, "parent_id": parent_id, "depth": depth}
            yield from listed(n["kids"], n["node_id"], depth + 1)

    names = [c.split()[0] for c in NODE.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in NODE.split(", ")])
    return pa.Table.from_pylist([{c: n[c] for c in names} for n in listed(_folded(roots, None, least), None, 0)], schema)


def nested_tree(items: DataFrame, vocabulary: Vocabulary, default: str = FRONT_MATTER, least: int = LEAST_CHARS) -> DataFrame:
    """(manual_id, node_id, parent_id, depth, title, aliases, node_type, subsystem, span_start, span_end, page_first,
    page_last, chapter) of items(manual_id, idx, page, kind, text, html).

    Depth 0 are chapters, 1 their nodes, 2 the causes below a symptom: in a troubleshooting chapter, titles that the
    vocabulary calls causes go below the last other title, whose span and pages grow with them. Tables give a type to nodes whose title
    has none. A node without children, image and ``least`` characters is thin: it goes into the sibling after it, the last into
    the one before, an only child into its parent, and its title becomes an alias. Chapters tile a manual's items; nodes tile their
    chapter from its first title on, causes the end of their symptom. ``idx`` numbers a manual's items in order of pages. Null texts are
    empty, and a manual without items has no node.
    """
    x = with_openings(with_chapters(items, default))
    text, html = F.coalesce("text", F.lit("")), F.coalesce("html", F.lit(""))
    by_item = Window.partitionBy("manual_id", "run").orderBy("idx")
    table = F.when(F.col("kind") == "table", Vocabulary._first(list(TABLE_TYPES), html))
    x = x.withColumn("leaf", F.sum((F.size("opens") > 0).cast("int")).over(by_item)).withColumn("table", table)
    parts = x.groupBy("manual_id", "run", "chapter", "leaf").agg(
        F.min_by("opens", "idx").alias("opens"), F.min("idx").alias("span_start"), (F.max("idx") + 1).alias("span_end"), F.min("page").alias("page_first"), F.max("page").alias("page_last"),
        F.sum(F.length(text) + F.length(html)).alias("chars"), F.max(F.coalesce(F.col("kind") == "image", F.lit(False))).alias("image"), F.min_by("table", F.when(F.col("table").isNotNull(), F.col("idx"))).alias("table"),
    )
    run = Window.partitionBy("manual_id", "run")
    whole = {"span_start": F.min, "span_end": F.max, "page_first": F.min, "page_last": F.max, "chars": F.sum, "image": F.max}
    parts = parts.withColumns({f"run_{c}": f(c).over(run) for c, f in whole.items()}).withColumn("first", F.row_number().over(run.orderBy("leaf")) == 1)
    # a chapter's row comes with its first part; of several nodes that begin at one item the last holds the items
    held = lambda k: k == F.size("opens") - 1
    node = lambda title, made, top, **c: F.struct(title.alias("title"), made.alias("made"), F.lit(top).alias("top"), *[v.alias(k) for k, v in c.items()])
    top = node(F.col("chapter"), F.lit(False), True, pos=F.lit(-1), **{c: F.col(f"run_{c}") for c in whole}, table=F.lit(None).cast("string"))
    own = lambda o, k: node(
        o["title"], o["made"], False, pos=k, span_start=F.col("span_start"), span_end=F.when(held(k), F.col("span_end")).otherwise(F.col("span_start")), page_first=F.col("page_first"),
        page_last=F.when(held(k), F.col("page_last")).otherwise(F.col("page_first")), chars=F.when(held(k), F.col("chars")).otherwise(0), image=held(k) & F.col("image"), table=F.when(held(k), F.col("table")),
    )
    rows = F.array_compact(F.concat(F.array(F.when(F.col("first"), top)), F.transform("opens", own)))
    nodes = parts.select("manual_id", "run", "chapter", "leaf", F.explode(rows).alias("n")).select("manual_id", "run", "chapter", "leaf", "n.*")
    kind = F.when(F.col("made") & F.col("title").rlike(_CODE), F.lit("fault_isolation")).otherwise(vocabulary.node_type(F.col("title")))
    kind = F.when(F.col("top"), "description").when(kind == "description", F.coalesce("table", kind)).otherwise(kind)
    system = F.coalesce(vocabulary.subsystem(F.col("title")), vocabulary.subsystem(F.col("chapter")), F.lit("general"))
    below = ~F.col("top") & F.contains("chapter", F.lit(TROUBLESHOOTING)) & (F.col("title").isin(*vocabulary.causes) if vocabulary.causes else F.lit(False))
    nth = F.row_number().over(run.orderBy("leaf", "pos")) - 1
    nodes = nodes.withColumns({"node_type": kind, "subsystem": system, "below": below, "nth": nth})
    longs = [F.col(c).cast("long").alias(c) for c in ("span_start", "span_end", "page_first", "page_last", "chars")]
    nodes = nodes.select(F.col("manual_id").cast("string").alias("manual_id"), "run", "nth", "chapter", "title", "node_type", "subsystem", "below", "image", X.node_id(F.col("subsystem"), F.col("node_type"), F.col("title")).alias("base"), *longs)
    return nodes.groupBy("manual_id").applyInArrow(lambda t: _nested(t, least), NODE)


def fault_cards(nodes: DataFrame, items: DataFrame, width: int = 4096) -> DataFrame:
    """(manual_id, code, item, symptom, fail_safe, detect_ref, isolate_ref) of each code in the blocks and fault tables of
    items: ``isolate_ref`` is the deepest node around the first block of the code, ``detect_ref`` that around the table with
    most rows of codes, the first on a tie; a code without a block is isolated there. The other columns are cells 2, 4 and 5 of the
    code's last row, empty without any. Nulls are empty; a manual without codes has no card."""
    payload = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.coalesce("html", F.lit("")))
    found = items.select("manual_id", "idx", F.explode(F.regexp_extract_all(payload, F.lit(_CODE), F.lit(1))).alias("code"))
    blocks = found.groupBy("manual_id", F.upper("code").alias("code")).agg(F.min("idx").alias("at"))
    tables = items.where((F.col("kind") == "table") & F.contains("html", F.lit(CODE_TABLE)))
    rows = tables.select("manual_id", "idx", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?s)<tr>(.*?)</tr>"), F.lit(1))).alias("nth", "row"))
    clean = lambda c: stripped(F.replace(F.regexp_replace(c, r"<[^>]+>", ""), F.lit("\n"), F.lit(" ")))
    rows = rows.withColumn("cells", F.transform(F.regexp_extract_all("row", F.lit(r"(?s)<td[^>]*>(.*?)</td>"), F.lit(1)), clean))
    rows = rows.withColumn("code", F.upper(F.get("cells", F.lit(0)))).where(F.col("code").rlike(r"^[PCBU]\d[0-9A-F]{3}$"))
    counts = rows.groupBy("manual_id", "idx").agg(F.count("*").alias("n"))
    detect = counts.groupBy("manual_id").agg(F.min_by("idx", F.struct(-F.col("n"), F.col("idx"))).alias("at")).withColumn("code", F.lit(None).cast("string"))
    spans = nodes.select("manual_id", F.col("span_start").cast("long").alias("start"), F.col("span_end").cast("long").alias("end"), F.struct("depth", "node_id").alias("span_id"))
    cell = lambda k: F.coalesce(F.get("cells", F.lit(k)), F.lit(""))
    payloads = rows.groupBy("manual_id", "code").agg(F.max_by(F.struct(cell(1).alias("item"), cell(3).alias("symptom"), cell(4).alias("fail_safe")), F.struct("idx", "nth")).alias("p"))
    # the table with most rows is one more point, without a code
    points = blocks.join(payloads, ["manual_id", "code"], "full").unionByName(detect, allowMissingColumns=True).withColumn("at", F.col("at").cast("long"))
    placed = deepest_span(points, spans, ["manual_id"], width).withColumn("ref", F.col("span_id.node_id"))
    out = placed.withColumn("detect_ref", F.max(F.when(F.col("code").isNull(), F.col("ref"))).over(Window.partitionBy("manual_id"))).where("code IS NOT NULL")
    part = lambda c: F.coalesce(F.col(f"p.{c}"), F.lit("")).alias(c)
    return out.select("manual_id", "code", part("item"), part("symptom"), part("fail_safe"), "detect_ref", F.coalesce("ref", "detect_ref").alias("isolate_ref"))
