"""Filters of lists, counts beside them, and lookups that pick one match."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import patterns

CLAIMS_A_TASK = 150_000  # of canonical_slugs


def listed(rows: DataFrame, equal: dict | None = None, at_least: dict | None = None, at_most: dict | None = None, contains: dict | None = None) -> DataFrame:
    """Rows that meet all bounds given; a bound of None is no bound."""
    tests = [F.col(k) == v for k, v in (equal or {}).items() if v is not None]
    tests += [F.col(k) >= v for k, v in (at_least or {}).items() if v is not None]
    tests += [F.col(k) <= v for k, v in (at_most or {}).items() if v is not None]
    tests += [F.contains(F.lower(k), F.lit(v.lower())) for k, v in (contains or {}).items() if v is not None]
    return rows.where(reduce(lambda a, b: a & b, tests)) if tests else rows


def page_with_total(rows: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """A page of ordered rows, each with the number of all rows: counted apart, so that no window gathers the table."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))  # one row


def with_or_without(rows: DataFrame, others: DataFrame, key: str, has: bool | None) -> DataFrame:
    """Rows that have others of the key, that have none, or all."""
    return rows if has is None else rows.join(others.select(key).distinct(), key, "left_semi" if has else "left_anti")


def section_choice(sections: DataFrame, group: str, hint: str, least_chars: int = 200) -> DataFrame:
    """The sections of a group whose title or body fits a pattern and whose body is long enough; a group with none keeps all."""
    fits = (F.col("title").rlike(hint) | F.col("body").rlike(hint)) & (F.length("body") >= least_chars)
    x = sections.withColumn("_fits", F.coalesce(fits, F.lit(False)))
    return x.withColumn("_some", F.max("_fits").over(Window.partitionBy(group))).where("_fits OR NOT _some").drop("_fits", "_some")


def counts_by(rows: DataFrame, *columns: str) -> DataFrame:
    """How many rows each value of each column has, as (column, value, n)."""
    return rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("c")).groupBy("c.column", "c.value").agg(F.count("*").alias("n"))


def pinned(inquiries: DataFrame, tokens: DataFrame, least: int = 4) -> DataFrame:
    """inquiries(id, text) with the only manual of tokens(manual_id, token) whose token is in the text, separators and case
    aside; null if none or several are. Tokens of fewer than ``least`` letters don't count. All tokens are searched at once, however many."""
    bare = lambda c: F.lower(F.regexp_replace(c, r"[\s_\-./]+", ""))
    t = tokens.select("manual_id", bare("token").alias("token")).where((F.length("token") >= least) & F.col("manual_id").isNotNull()).distinct()
    owners = t.groupBy("token").agg(F.count("*").alias("n"), F.min("manual_id").alias("manual_id"))
    hits = patterns.found_in(inquiries.select("id", bare("text").alias("text")), owners.select(F.col("token").alias("pattern_id"), F.col("token").alias("pattern")))
    one = hits.join(owners, F.col("pattern_id") == F.col("token")).groupBy("id").agg(F.max("n").alias("n"), F.min("manual_id").alias("manual_id"), F.max("manual_id").alias("_most"))
    one = one.where("n = 1 AND manual_id = _most")
    return inquiries.select("id").join(one.select("id", "manual_id"), "id", "left")


def canonical_slugs(claims: DataFrame, slugs: DataFrame, slug_of) -> DataFrame:
    """claims(id, position, slug) with the known slugs(id, nth, known) they mean: the same, the same once made a slug, the first
    that contains it; else as they are. Of equal ones the first of an id stays."""
    # both sides are dealt by id to tasks of bounded size, which the join and the groups go on with; counting reads the claims once more
    tasks = max(int(claims.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-claims.count() // CLAIMS_A_TASK))
    x = claims.withColumn("made", slug_of(F.col("slug"))).repartition(tasks, "id")
    y = x.join(slugs.repartition(tasks, "id"), "id", "left")
    rank = F.when(F.col("slug") == F.col("known"), 0).when(F.col("made") == F.col("known"), 1).when((F.col("made") != "") & F.contains("known", F.col("made")), 2)
    best = F.min_by(F.when(rank.isNotNull(), F.col("known")), F.when(rank.isNotNull(), F.struct(rank, F.col("nth"), F.col("known"))))
    found = y.groupBy("id", "position", "slug").agg(best.alias("known"))
    return found.groupBy("id", F.coalesce("known", "slug").alias("slug")).agg(F.min("position").alias("position"))


def closest_slug(requests: DataFrame, slugs: DataFrame, slug_of, least: float = 0.4) -> DataFrame:
    """requests(id, name) with the nearest of slugs(id, slug): the same, one within the other, or the least edit distance if
    it leaves ``least`` of the longer's letters; null if none. Edit distance stands for the longest-match ratio of other tools."""
    x = requests.withColumn("made", slug_of(F.col("name"))).join(slugs, "id")
    alike = 1 - F.levenshtein("made", "slug") / F.greatest(F.length("made"), F.length("slug"), F.lit(1))
    inside = (F.col("made") != "") & (F.contains("slug", F.col("made")) | F.contains("made", F.col("slug")))
    rank = F.when(F.col("made") == F.col("slug"), F.lit(0.0)).when(inside, 1.0).when(alike >= least, 3 - alike)
    best = F.min_by(F.when(rank.isNotNull(), F.col("slug")), F.when(rank.isNotNull(), F.struct(rank, F.col("slug"))))
    return requests.join(x.groupBy("id", "name").agg(best.alias("slug")), ["id", "name"], "left")


def closest_by_blocks(requests: DataFrame, slugs: DataFrame, slug_of, least: float = 0.4) -> DataFrame:
    """requests(id, name) with the known slug of slugs(id, nth, slug) that each name's slug means: the same; else the first in
    order of nth that contains it or that it contains; else the one of the greatest ratio of letters in matching blocks (the longest
    common block, and so on left and right of it), the first on a tie, if that is ``least`` or more; null if none.

    Equal slugs meet by a join on id and slug. Others are paired within an id only, and blocks are searched where the letters that both have,
    in any order, allow a ratio of ``least``. A null name, id or slug has no match; repeated requests have one row; an empty
    slug is in every other, and every other in none.
    """
    asked = requests.select("id", "name").distinct()
    x = asked.withColumn("made", slug_of(F.col("name"))).where("id IS NOT NULL AND made IS NOT NULL")
    known = slugs.where("id IS NOT NULL AND slug IS NOT NULL").groupBy("id", "slug").agg(F.min("nth").alias("nth"))
    same = x.join(known, (x["id"] == known["id"]) & (x["made"] == known["slug"])).select(x["id"], "name", "slug")
    pairs = x.join(same.select("id", "name"), ["id", "name"], "left_anti").join(known, "id")
    inside = F.contains("slug", F.col("made")) | F.contains("made", F.col("slug"))
    one, other = F.split("made", ""), F.split("slug", "")
    held = lambda a, letter: F.size(F.filter(a, lambda y: y == letter))
    common = F.aggregate(F.array_intersect(one, other), F.lit(0), lambda n, letter: n + F.least(held(one, letter), held(other, letter)))
    possible = 2 * common / (F.length("made") + F.length("slug")) >= least - 1e-9

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, p, q).ratio() for p, q in zip(a, b)])

    pairs = pairs.withColumn("inside", inside).withColumn("possible", possible).where("inside OR possible")
    contained = pairs.where("inside").groupBy("id", "name").agg(F.min_by("slug", F.struct("nth", "slug")).alias("slug"))
    rest = pairs.where("NOT inside").join(contained.select("id", "name"), ["id", "name"], "left_anti").withColumn("ratio", ratio("made", "slug")).where((F.col("ratio") >= least) & (F.col("ratio") > 0))
    nearest = rest.groupBy("id", "name").agg(F.min_by("slug", F.struct(-F.col("ratio"), "nth", "slug")).alias("slug"))
    found = same.unionByName(contained).unionByName(nearest).withColumnsRenamed({"id": "_id", "name": "_name"})
    return asked.join(found, F.col("id").eqNullSafe(F.col("_id")) & F.col("name").eqNullSafe(F.col("_name")), "left").select("id", "name", "slug")


def nested_in(boundaries: DataFrame, chapters: DataFrame, keys: list[str], at: Column) -> DataFrame:
    """Boundaries with the chapter(keys, first, last, chapter) whose closed range holds them; chapters of a key don't overlap, so
    it is the last that begins at or before: a window over both, with no range join."""
    b = boundaries.withColumn("_at", at).withColumn("_side", F.lit(1))
    c = chapters.select(*keys, F.col("first").alias("_at"), F.lit(0).alias("_side"), F.struct("last", "chapter").alias("_c"))
    order = Window.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    x = b.unionByName(c, allowMissingColumns=True).withColumn("_c", F.last("_c", ignorenulls=True).over(order)).where("_side = 1")
    return x.withColumn("chapter", F.when(F.col("_at") <= F.col("_c.last"), F.col("_c.chapter"))).drop("_at", "_side", "_c")
