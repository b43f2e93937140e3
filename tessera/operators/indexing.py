"""Parts of a manual's index: ids, code cards, composed content, migrated slugs, and the gates that an index must pass."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import texts as X


def suffixed(bases: list) -> list:
    """An id for each base in turn: the base, or with the least suffix from -2 on that none before has; null stays null."""
    used: set = set()
    tried: dict = {}  # the last suffix of each base; all smaller ones are taken for good
    ids = []
    for base in bases:
        found = base
        while found is not None and found in used:
            tried[base] = tried.get(base, 1) + 1
            found = f"{base}-{tried[base]}"
        used.add(found)
        ids.append(found)
    return ids


def unique_ids(nodes: DataFrame) -> DataFrame:
    """nodes(manual_id, nth, base) with an id each: the base, or with the least suffix from -2 on that no node before it has,
    suffixed or natural. A manual's nodes go to one task, which passes over them once, in order of nth and base; a null base has a null id,
    repeated rows are nodes of their own, and an empty table gives an empty result."""

    def name(table: pa.Table) -> pa.Table:
        table = table.sort_by([("nth", "ascending"), ("base", "ascending")])
        return table.append_column("node_id", pa.array(suffixed(table.column("base").to_pylist()), pa.string()))

    x = nodes.select("manual_id", "nth", F.col("base").cast("string").alias("base"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in x.schema.fields) + ", node_id string"
    return x.groupBy("manual_id").applyInArrow(name, schema)


def code_cards(nodes: DataFrame, items: DataFrame, pattern: str = r"\b[PCBU]\d[0-9A-F]{3}\b") -> DataFrame:
    """(manual_id, code, isolate_ref, detect_ref, n_rows) of items(manual_id, idx, kind, text) and nodes(manual_id, node_id,
    node_type, span_start, span_end): the procedure node with most rows that name a code, and the table node with most; the
    smaller id on a tie. Spans of one type don't overlap, so an item's node of a type is the last that begins before it."""
    codes = items.select("manual_id", "idx", F.explode(F.array_distinct(F.regexp_extract_all(F.upper("text"), F.lit(pattern), F.lit(0)))).alias("code"))
    sides = codes.select("manual_id", F.col("idx").alias("at"), F.lit(1).alias("side"), "code")
    starts = nodes.select("manual_id", F.col("span_start").alias("at"), F.lit(0).alias("side"), F.struct("node_id", "span_end").alias("n"), "node_type")
    order = Window.partitionBy("manual_id").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    x = sides.unionByName(starts, allowMissingColumns=True)
    of = lambda kind: F.last(F.when(F.col("node_type") == kind, F.col("n")), ignorenulls=True).over(order)
    x = x.withColumn("p", of("procedure")).withColumn("t", of("table")).where("side = 1")
    inside = lambda c: F.when(F.col("at") < F.col(f"{c}.span_end"), F.col(f"{c}.node_id"))
    x = x.select("manual_id", "code", inside("p").alias("p"), inside("t").alias("t"))
    total = x.groupBy("manual_id", "code").agg(F.count("*").alias("n_rows"))

    def most(c: str, name: str) -> DataFrame:
        n = x.where(F.col(c).isNotNull()).groupBy("manual_id", "code", c).agg(F.count("*").alias("n"))
        return n.groupBy("manual_id", "code").agg(F.min_by(c, F.struct(-F.col("n"), F.col(c))).alias(name))

    return total.join(most("p", "isolate_ref"), ["manual_id", "code"], "left").join(most("t", "detect_ref"), ["manual_id", "code"], "left")


def composed(items: DataFrame, baseline: DataFrame) -> DataFrame:
    """M9: (doc_id, page, place, line, backfilled): the lines of items(doc_id, page, idx, text) page by page, each page's followed by those
    of its baseline(doc_id, page, nth, line) that the page's items don't hold; ``place`` counts a document's lines from 0."""
    own = items.select("doc_id", "page", "idx", F.posexplode(F.split("text", "\n")).alias("k", "line")).where(F.trim("line") != "")
    bare = lambda c: X.letters_only(F.col(c))
    page = items.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda r: r["text"]), "").alias("all"))
    lost = baseline.where(F.length(bare("line")) >= 4).join(page.withColumn("all", bare("all")), ["doc_id", "page"], "left").where(~F.coalesce(F.contains("all", bare("line")), F.lit(False)))
    both = own.select("doc_id", "page", F.lit(0).alias("late"), "idx", "k", "line").unionByName(lost.select("doc_id", "page", F.lit(1).alias("late"), F.col("nth").alias("idx"), F.lit(0).alias("k"), "line"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "late", "idx", "k")) - 1
    return both.select("doc_id", "page", place.alias("place"), "line", (F.col("late") == 1).alias("backfilled"))


def migrated_slugs(old: DataFrame, new: DataFrame) -> DataFrame:
    """old(manual_id, slug, quote) with the slug of new(manual_id, slug, text) that took its place, and how it was found: 0 the same
    slug, 1 the same but for separators, 2 the same without a number at the end, 3 one within the other, 4 the quote is in its text.
    The shorter slug counts on a tie, then the smaller; null if nothing fits."""
    o = old.select("manual_id", "slug", "quote", X.normal_slug(F.col("slug")).alias("key"), F.regexp_replace("slug", r"-\d+$", "").alias("stem"))
    n = new.select("manual_id", F.col("slug").alias("to"), X.normal_slug(F.col("slug")).alias("to_key"), F.regexp_replace("slug", r"-\d+$", "").alias("to_stem"), F.lower(X.single_spaced(F.col("text"))).alias("text"))
    x = o.join(n, "manual_id", "left")
    quoted = F.contains("text", F.lower(X.single_spaced(F.col("quote")))) & (F.trim("quote") != "")
    inside = (F.length("key") >= 4) & (F.length("to_key") >= 4) & (F.contains("key", F.col("to_key")) | F.contains("to_key", F.col("key")))
    how = F.when(F.col("slug") == F.col("to"), 0).when(F.col("key") == F.col("to_key"), 1).when(F.col("stem") == F.col("to_stem"), 2).when(inside, 3).when(quoted, 4)
    best = F.min(F.when(how.isNotNull(), F.struct(how.alias("how"), F.length("to").alias("n"), F.col("to").alias("to"))))
    return x.groupBy("manual_id", "slug").agg(best.alias("b")).select("manual_id", "slug", F.col("b.to").alias("new_slug"), F.col("b.how").alias("how"))


def gates(nodes: DataFrame, items: DataFrame, cards: DataFrame, subsystems: list[str], most_noise: float = 0.20) -> DataFrame:
    """(manual_id, gate, n_bad, passes) for each manual of nodes(manual_id, node_id, title, subsystem, is_leaf,
    span_start, span_end) and items(manual_id, idx, kind, text): ``tiling`` (leaves follow one another from the first item to the last),
    ``shells`` (empty spans), ``codes`` (codes in the text without a card), ``refs`` (cards that point to no node), ``titles`` (of fewer
    than 2 or more than 60 letters, or with a bullet), ``vocabulary`` (unknown subsystems), ``noise`` (items of no kind, over a share)."""
    ends = items.groupBy("manual_id").agg(F.min("idx").alias("lo"), (F.max("idx") + 1).alias("hi"), F.count("*").alias("n"), F.count(F.when(F.col("kind") == "noise", 1)).alias("noise"))
    leaves = nodes.where("is_leaf").join(ends.select("manual_id", "lo", "hi"), "manual_id")
    order = Window.partitionBy("manual_id").orderBy("span_start", "span_end")
    broken = F.col("span_start") != F.coalesce(F.lag("span_end").over(order), F.col("lo"))
    last = F.row_number().over(Window.partitionBy("manual_id").orderBy(F.desc("span_start"), F.desc("span_end"))) == 1
    tiling = leaves.withColumn("bad", broken.cast("int") + (last & (F.col("span_end") != F.col("hi"))).cast("int")).groupBy("manual_id").agg(F.sum("bad").alias("tiling"))
    odd_title = (F.length("title") < 2) | (F.length("title") > 60) | F.col("title").rlike("^[•●▪-]")
    per_node = nodes.groupBy("manual_id").agg(
        F.count(F.when(F.col("span_start") >= F.col("span_end"), 1)).alias("shells"), F.count(F.when(odd_title, 1)).alias("titles"), F.count(F.when(~F.col("subsystem").isin(*subsystems), 1)).alias("vocabulary"),
    )
    found = items.select("manual_id", F.explode(F.regexp_extract_all(F.upper("text"), F.lit(r"\b[PCBU]\d[0-9A-F]{3}\b"), F.lit(0))).alias("code")).distinct()
    codes = found.join(cards.select("manual_id", "code"), ["manual_id", "code"], "left_anti").groupBy("manual_id").agg(F.count("*").alias("codes"))
    refs = cards.select("manual_id", F.explode(F.array_compact(F.array("isolate_ref", "detect_ref"))).alias("node_id"))
    refs = refs.join(nodes.select("manual_id", "node_id"), ["manual_id", "node_id"], "left_anti").groupBy("manual_id").agg(F.count("*").alias("refs"))
    noise = ends.select("manual_id", F.when(F.col("noise") > most_noise * F.col("n"), F.col("noise")).otherwise(0).alias("noise"))
    x = per_node
    for other in (tiling, codes, refs, noise):
        x = x.join(other, "manual_id", "left")
    names = ["tiling", "shells", "codes", "refs", "titles", "vocabulary", "noise"]
    rows = F.array(*[F.struct(F.lit(g).alias("gate"), F.coalesce(g, F.lit(0)).cast("long").alias("n_bad")) for g in names])
    return x.select("manual_id", F.explode(rows).alias("g")).select("manual_id", "g.gate", "g.n_bad", (F.col("g.n_bad") == 0).alias("passes"))


LEAST_CHARS = 50


def merged_leaves(leaves: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """leaves(manual_id, parent, nth, title, span_start, span_end, chars, keeps) in order below their parents, without thin ones: a leaf of
    fewer than ``least`` characters that has no image or children (``keeps``) joins the next one, with what that then holds; at the
    end of the list the one before. The joined leaf keeps the title of the leaf that took the others in; their titles are its
    aliases. A list of thin leaves alone is one leaf. The leaves of one parent are one list, folded in order."""
    row = F.struct("nth", "title", "span_start", "span_end", "chars", "keeps")
    x = leaves.groupBy("manual_id", "parent").agg(F.array_sort(F.collect_list(row)).alias("r"))
    start = F.struct(F.array().cast("array<int>").alias("groups"), F.lit(0).alias("g"), F.lit(0).cast("long").alias("chars"), F.lit(False).alias("open"))

    def step(a: Column, leaf: Column) -> Column:
        chars = a["chars"] + leaf["chars"]
        full = leaf["keeps"] | (chars >= least)
        return F.struct(
            F.concat(a["groups"], F.array(a["g"])).alias("groups"), F.when(full, a["g"] + 1).otherwise(a["g"]).alias("g"), F.when(full, F.lit(0)).otherwise(chars).cast("long").alias("chars"), (~full).alias("open")
        )

    x = x.withColumn("a", F.aggregate("r", start, step))
    x = x.withColumn("groups", F.transform("a.groups", lambda g: F.when(F.col("a.open") & (g == F.col("a.g")) & (g > 0), g - 1).otherwise(g)))
    # the leaf that takes in: the last of its group as it was before the end of the list was added
    y = x.select("manual_id", "parent", F.explode(F.arrays_zip("r", "groups", F.col("a.groups").alias("was"))).alias("z")).select("manual_id", "parent", "z.groups", "z.was", "z.r.*")
    y = y.groupBy("manual_id", "parent", "groups").agg(
        F.max_by(F.struct("nth", "title"), F.when(F.col("was") == F.col("groups"), F.col("nth"))).alias("own"), F.array_sort(F.collect_list(F.struct("nth", "title"))).alias("all"),
        F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end"), F.sum("chars").alias("chars"),
    )
    aliases = F.transform(F.filter("all", lambda t: t["nth"] != F.col("own.nth")), lambda t: t["title"])
    return y.select("manual_id", "parent", F.col("own.nth").alias("nth"), F.col("own.title").alias("title"), aliases.alias("aliases"), "span_start", "span_end", "chars")


def build_tree(items: DataFrame, default: str = "front matter") -> DataFrame:
    """(manual_id, parent, nth, title, aliases, span_start, span_end, chars, chapter) of items(manual_id, idx, page, kind, text, html):
    chapters are runs of pages with one running header, which pages without a header inherit; a chapter's leaves begin at its title
    candidates that are no noise, the first at its start, and thin leaves are merged. The leaves of a manual tile its items."""
    key = ["manual_id"]
    title = F.when(F.col("kind") == "page_header", F.nullif(F.trim("text"), F.lit("")))
    pages = items.groupBy(*key, "page").agg(F.min_by(title, F.when(title.isNotNull(), F.col("idx"))).alias("title"), F.min("idx").alias("lo"), (F.max("idx") + 1).alias("hi"))
    by_page = Window.partitionBy(*key).orderBy("page")
    pages = pages.withColumn("chapter", F.coalesce(F.last("title", ignorenulls=True).over(by_page), F.lit(default)))
    new = F.coalesce((F.col("chapter") != F.lag("chapter").over(by_page)).cast("int"), F.lit(1))
    pages = pages.withColumn("new", new).withColumn("run", F.sum("new").over(by_page))
    x = items.join(pages.select(*key, "page", "run", "chapter"), [*key, "page"])
    noise = (F.length(F.trim("text")) < 2) | (F.length(F.trim("text")) > 60) | F.trim("text").rlike("^[•●▪-]|。$")
    order = Window.partitionBy(*key, "run").orderBy("idx")
    opens = (F.col("kind") == "title_candidate") & ~noise
    begins = opens | (F.row_number().over(order) == 1)
    # a title right at the start is the first leaf's, not a second leaf
    x = x.withColumn("begins", begins.cast("int")).withColumn("leaf", F.sum("begins").over(order))
    named = F.min_by(F.when(opens, F.trim("text")), F.when(opens, F.col("idx")))
    chars = F.sum(F.length(F.coalesce("text", F.lit(""))) + F.length(F.coalesce("html", F.lit(""))))
    leaves = x.groupBy(*key, "run", "chapter", "leaf").agg(
        named.alias("own"), F.min("idx").alias("span_start"), (F.max("idx") + 1).alias("span_end"), chars.alias("chars"), F.max(F.col("kind") == "image").alias("keeps"),
    )
    leaves = leaves.withColumn("title", F.coalesce("own", "chapter")).withColumnRenamed("run", "parent").withColumnRenamed("leaf", "nth")
    chapters = leaves.select(*key, "parent", "chapter").distinct()
    return merged_leaves(leaves).join(chapters, [*key, "parent"])


def build_index(items: DataFrame, subsystem: Column, subsystems: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, cards, gates) of items: the tree with ids and a subsystem by title, the code cards, and what each gate finds."""
    tree = build_tree(items)
    order = Window.partitionBy("manual_id").orderBy("span_start")
    kind = F.when(F.lower("title").rlike("table|list|codes"), "table").otherwise("procedure")
    x = tree.withColumn("subsystem", subsystem).withColumn("node_type", kind).withColumn("n", F.row_number().over(order))
    ids = unique_ids(x.select("manual_id", F.col("n").alias("nth"), X.node_id(F.col("subsystem"), F.col("node_type"), F.col("title")).alias("base")))
    nodes = x.join(ids.select("manual_id", F.col("nth").alias("n"), "node_id"), ["manual_id", "n"])
    nodes = nodes.select("manual_id", "node_id", "title", "aliases", "chapter", "subsystem", "node_type", F.lit(True).alias("is_leaf"), "span_start", "span_end")
    cards = code_cards(nodes, items)
    return nodes, cards, gates(nodes, items, cards, subsystems)
