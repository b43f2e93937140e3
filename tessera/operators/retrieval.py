"""Exact vector, keyword and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def vector_top_k(chunks: DataFrame, query: list[float] | DataFrame, k: int, where: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k chunks nearest to a query by cosine similarity, ties to the smaller id; k is held within
    1 to 20. The query is a vector, or a frame whose first column holds one in its only row; without
    that row there are no hits."""
    rows = (chunks if where is None else chunks.where(where)).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    if isinstance(query, DataFrame):
        rows = rows.join(F.broadcast(query.select(F.col(query.columns[0]).cast("array<double>").alias("q")).limit(1)))  # one row
    else:
        rows = rows.withColumn("q", F.lit([float(x) for x in query]))
    v, q = F.col("v"), F.col("q")
    norm = F.sqrt(_dot(v, v)) * F.sqrt(_dot(q, q))
    scored = rows.select("id", F.when(norm > 0, _dot(v, q) / norm).alias("similarity")).where(F.col("similarity").isNotNull())
    return scored.orderBy(F.desc("similarity"), "id").limit(max(1, min(20, k)))


def keyword_scores(chunks: DataFrame, tokens: list[str], id_col: str, text_col: str) -> DataFrame:
    """(id, rank): an OR query's rank, the distinct tokens found plus the share of matches among words; only hits."""
    words = F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^a-z0-9]+")
    x = chunks.select(F.col(id_col).alias("id"), words.alias("w"))
    wanted = F.array(*[F.lit(t) for t in tokens])
    hits = F.size(F.filter("w", lambda t: F.array_contains(wanted, t)))
    x = x.select("id", F.size(F.array_intersect("w", wanted)).alias("n"), (hits / F.size("w")).alias("share"))
    return x.where("n > 0").select("id", (F.col("n") + F.col("share")).alias("rank"))


def hybrid(semantic: DataFrame, keyword: DataFrame, alpha: float, k: int) -> DataFrame:
    """Fusion of (id, similarity) and (id, rank): alpha times the one plus the rest times the
    other, ranks scaled between the least and the greatest positive one (1 if all are equal)."""
    alpha = max(0.0, min(1.0, alpha))
    a = semantic.select("id", "similarity", F.lit(None).cast("double").alias("rank"))
    both = a.unionByName(keyword.select("id", F.lit(None).cast("double").alias("similarity"), "rank"))
    each = both.groupBy("id").agg(F.max("similarity").alias("similarity"), F.max("rank").alias("rank"))
    pool = Window.partitionBy(F.lit(0))  # the pools' few rows
    positive = F.when(F.col("rank") > 0, F.col("rank"))
    each = each.withColumn("lo", F.min(positive).over(pool)).withColumn("hi", F.max(positive).over(pool))
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col("rank") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0)
    keyword_part = F.when(F.col("rank") > 0, scaled).otherwise(0.0)
    score = alpha * F.coalesce("similarity", F.lit(0.0)) + (1 - alpha) * keyword_part
    return each.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)
