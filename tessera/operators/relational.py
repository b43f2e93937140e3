"""Paging, latest rows, lookups and unions of ordinary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def page(rows: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def latest_per_group(rows: DataFrame, key: str, at: list[str], columns: list[str]) -> DataFrame:
    """One row per key: that with the greatest ``at``; a combined aggregate, with no sort of the groups."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*at)).alias("_r")).select(key, "_r.*")


def with_counts(rows: DataFrame, reviews: DataFrame, key: str, at: str) -> DataFrame:
    """Each row with the number and latest time of its reviews; zero and null without any."""
    found = reviews.groupBy(key).agg(F.count("*").alias("n_reviews"), F.max(at).alias("latest"))
    return rows.join(found, key, "left").withColumn("n_reviews", F.coalesce("n_reviews", F.lit(0)))


def upsert(target: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The target with rows of ``changes`` in place of those with the same key, and the new ones added."""
    return target.join(changes.select(key), key, "left_anti").unionByName(changes)


def tagged_union(tables: dict[str, DataFrame]) -> DataFrame:
    """All rows of several tables, each with its table's name as ``tab``; a column that a table lacks is null."""
    out = None
    for name, rows in tables.items():
        tagged = rows.withColumn("tab", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def within_tolerance(expected: DataFrame, actual: DataFrame, key: str, relative: float, at_zero: float = 0.01) -> DataFrame:
    """Expected values with the actual one of the same key, and whether it is near enough."""
    x = expected.join(actual, key, "left")
    bound = F.when(F.col("expected") == 0, at_zero).otherwise(F.abs("expected") * relative)
    return x.withColumn("ok", F.coalesce(F.abs(F.col("actual") - F.col("expected")) <= bound, F.lit(False)))
