"""Running sums and last values over series that no single task has to order.

A window by series puts a whole series in one task. Here a series is cut into ranges of its order column: each
range is summed up (sum, last value), the summaries are scanned over ranges, and what each range begins
with goes into it as one more row, so a window within the range continues from there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
ROWS_A_TASK = 1_000_000


def tasks_for(spark: SparkSession, n_rows: int) -> int:
    """Tasks of at most about ``ROWS_A_TASK`` rows, as many as the session's shuffles have at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // ROWS_A_TASK))


def running(
    rows: DataFrame, keys: list[str], at: str, ties: list[str], width: int, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, befores: dict[str, Column] | None = None,
    mins: dict[str, Column] | None = None, tasks: int | None = None,
) -> DataFrame:
    """Rows with columns over all rows of their keys up to their own in order of (at, ties): ``sums`` of values with the row's own,
    ``lasts`` the last value that is not null, the row's own included, ``befores`` the same without it, ``mins`` the smallest with the row's own.

    ``at`` is a number, a time (in microseconds) or null; a range is ``width`` of it, so a task orders one range of a series, and one row a range is scanned by
    series. All rows with one ``at`` are in one range. Nulls come first, as keys they are keys, a sum of no values is 0, rows that tie in everything
    come in any order, and an empty table stays empty. The ranges are dealt to ``tasks`` tasks, by default as many as the session's shuffles have.
    """
    sums, lasts, befores, mins = sums or {}, lasts or {}, befores or {}, mins or {}
    values = {f"_v{k}": c for k, c in enumerate([*sums.values(), *lasts.values(), *befores.values(), *mins.values()])}
    names = dict(zip([*sums, *lasts, *befores, *mins], values))
    part, order = [*keys, "_range"], [at, *ties]
    place = F.unix_micros(F.col(at).cast("timestamp")) if rows.schema[at].dataType.typeName().startswith("timestamp") else F.col(at)
    x = rows.withColumns({"_range": F.floor(place / width), **values})

    def total(n: str, w=None) -> Column:
        c = F.sum(names[n]) if n in sums else F.min(names[n]) if n in mins else F.last(names[n], ignorenulls=True)
        return c.over(w) if w is not None else c

    def summary(n: str) -> Column:
        c = names[n]
        return (F.sum(c) if n in sums else F.min(c) if n in mins else F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order)))).alias(c)

    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = x.groupBy(*part).agg(*[summary(n) for n in names]).select(*part, F.lit(0).alias("_own"), *[total(n, before).alias(names[n]) for n in names])
    both = x.withColumn("_own", F.lit(1)).unionByName(carried, allowMissingColumns=True)
    if tasks:
        both = both.repartition(tasks, *part)
    inside = Window.partitionBy(*part).orderBy("_own", *order)
    upto, past = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    out = both.withColumns({f"_o{c}": F.coalesce(total(n, upto), F.lit(0)) if n in sums else total(n, past if n in befores else upto) for n, c in names.items()})
    return out.where("_own = 1").select(*[c for c in rows.columns if c not in names], *[F.col(f"_o{c}").alias(n) for n, c in names.items()])


def deepest_span(points: DataFrame, spans: DataFrame, keys: list[str], width: int, tasks: int | None = None) -> DataFrame:
    """points(keys, at, ...) with the ``span_id`` of the deepest of nested half-open spans(keys, start, end, span_id) around each, null if
    none; of equal spans the one with the greater id.

    Spans of one key nest or are apart, so the spans open at a point are as many as its depth, and the deepest is the last one
    that opened at that depth: a running sum gives the depth, a last value by depth the span. Nothing is compared in pairs. Spans without
    extent hold no point; repeated points stay, a point or span without a place meets none. ``tasks`` is that of ``running``.
    """
    real = spans.where("start < end")
    # at one place: ends, then starts from the longest on, then points
    edge = lambda c, side, d: F.struct(F.col(c).alias("at"), F.lit(side).alias("_side"), F.lit(d).alias("_d"), (F.col("end") * -side).alias("_far"))
    edges = real.select(*keys, F.col("span_id").alias("_span"), F.explode(F.array(edge("end", 0, -1), edge("start", 1, 1))).alias("_e")).select(*keys, "_e.*", "_span")
    both = points.withColumns({"_side": F.lit(2), "_d": F.lit(0)}).unionByName(edges, allowMissingColumns=True)
    x = running(both, keys, "at", ["_side", "_far", "_span"], width, sums={"_depth": F.col("_d")}, tasks=tasks).where("_side > 0")
    opened = F.when(F.col("_side") == 1, F.col("_span"))
    x = running(x, [*keys, "_depth"], "at", ["_side", "_far", "_span"], width, lasts={"span_id": opened}, tasks=tasks).where("_side = 2")
    return x.withColumn("span_id", F.when(F.col("_depth") > 0, F.col("span_id"))).select(*points.columns, "span_id")
