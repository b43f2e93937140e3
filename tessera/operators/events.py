"""Conditions on signals, islands of rows that meet them, and the events these make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.scans import DAY_US, running
from tessera.operators.statistics import KEYS, by_time

GRID_RUN = 4096  # grid points that one array holds


def condition(kind: str, threshold: float | None = None) -> Column:
    """Whether a row of (us, value, before, before_us) meets a predicate; null values meet only ``missing``.

    Crossings need a value in the row just before: after a gap none can fire.
    """
    v, p = F.col("value"), F.col("before")
    seconds = (F.col("us") - F.col("before_us")) / 1e6
    rate = F.when(seconds > 0, (v - p) / seconds)
    found = {
        "above": v > threshold, "below": v < threshold, "rising_above": (p <= threshold) & (v > threshold), "falling_below": (p >= threshold) & (v < threshold),
        "rate_of_change_above": rate > threshold, "rate_of_change_below": rate < threshold, "missing": v.isNull(),
    }
    return F.coalesce(found[kind], F.lit(False))


def find_events(rows: DataFrame, kind: str, threshold: float | None = None, min_seconds: float = 1.0, merge_seconds: float = 5.0, width: int = DAY_US) -> DataFrame:
    """(session, signal, start_us, end_us, peak, seconds, n_rows): events in which a condition holds.

    Neighbouring rows that meet it form an island. Islands shorter than
    ``min_seconds`` go first; then those at most ``merge_seconds`` apart are one event.
    The peak is the smallest value for conditions that look down, else the largest. Rows are ordered
    in ranges of ``width`` microseconds; only a series' islands are ordered as a whole.
    """
    down = kind in ("below", "falling_below", "rate_of_change_below")
    x = running(rows, KEYS, "us", ["row_id"], width, befores={"_before": F.struct("value", "us")})
    x = x.withColumn("before", F.col("_before.value")).withColumn("before_us", F.col("_before.us"))
    # rows of one island have equally many rows before them that don't meet the condition
    x = x.withColumn("met", condition(kind, threshold))
    x = running(x, KEYS, "us", ["row_id"], width, sums={"island": (~F.col("met")).cast("int")}).where("met")
    peak = (F.min if down else F.max)("value").alias("peak")
    islands = x.groupBy(*KEYS, "island").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), peak, F.count("*").alias("n_rows"))
    islands = islands.where((F.col("end_us") - F.col("start_us")) / 1e6 >= min_seconds)
    order = Window.partitionBy(*KEYS).orderBy("start_us", "island")
    apart = (F.col("start_us") - F.max("end_us").over(order.rowsBetween(Window.unboundedPreceding, -1))) / 1e6
    merged = islands.withColumn("event", F.sum(F.coalesce((apart > merge_seconds).cast("int"), F.lit(1))).over(order))
    out = merged.groupBy(*KEYS, "event").agg(
        F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), (F.min if down else F.max)("peak").alias("peak"), F.sum("n_rows").alias("n_rows")
    )
    return out.withColumn("seconds", (F.col("end_us") - F.col("start_us")) / 1e6).drop("event")


def consecutive_distinct(rows: DataFrame, width: int = DAY_US) -> DataFrame:
    """Rows whose value differs from that of the row before; rows are ordered in ranges of ``width`` microseconds."""
    x = running(rows, KEYS, "us", ["row_id"], width, befores={"_before": F.struct("value")})
    return x.where(F.col("_before").isNull() | ~F.col("value").eqNullSafe(F.col("_before.value"))).drop("_before")


def read_window(rows: DataFrame, start_us: int | None, end_us: int | None, max_rows: int) -> DataFrame:
    """Rows of a closed window, thinned to evenly spaced ones of each series; first and last always stay."""
    if start_us is not None:
        rows = rows.where(F.col("us") >= start_us)
    if end_us is not None:
        rows = rows.where(F.col("us") <= end_us)
    x = rows.withColumn("k", F.row_number().over(by_time()) - 1).withColumn("total", F.count("*").over(Window.partitionBy(*KEYS)))
    # k is chosen if some i gives floor(i * total / max_rows) = k
    i = F.ceil(F.col("k") * max_rows / F.col("total"))
    chosen = (i < max_rows) & (F.floor(i * F.col("total") / max_rows) == F.col("k"))
    ends = (F.col("k") == 0) | (F.col("k") == F.col("total") - 1)
    return x.where((F.col("total") <= max_rows) | chosen | ends).drop("total")


def resample(rows: DataFrame, step_us: int, fill: str = "interpolate", width: int = DAY_US) -> DataFrame:
    """(session, signal, us, value) on a uniform grid from each series' first to its last timestamp.

    fill: ``interpolate`` is linear in time between neighbours, ``ffill`` and ``bfill``
    take one of them, ``none`` keeps only values on the grid. Duplicate timestamps
    must be averaged before. Rows are ordered in ranges of ``width`` microseconds; the grid is not ordered.
    """
    own = F.struct("us", "value")
    # only the rows are ordered; each then makes the grid points after the row before it and up to its own time, the first row the grid's first
    x = running(rows.where("us IS NOT NULL").select(*KEYS, "us", "value"), KEYS, "us", [], width, befores={"l": own}, mins={"lo": F.col("us")})
    x = x.withColumns({"a": F.coalesce(F.expr(f"(l.us - lo) div {step_us} + 1"), F.lit(0).cast("long")), "z": F.expr(f"(us - lo) div {step_us}")}).where("a <= z")
    # points in runs of bounded length: one array for a long gap would not fit in a row
    x = x.withColumn("first", F.explode(F.sequence("a", "z", F.lit(GRID_RUN).cast("long"))))
    x = x.withColumn("k", F.explode(F.sequence("first", F.least("z", F.col("first") + GRID_RUN - 1))))
    x = x.select(*KEYS, (F.col("lo") + F.col("k") * step_us).alias("us"), "l", own.alias("r"))
    on = F.col("r.us") == F.col("us")
    share = (F.col("us") - F.col("l.us")) / (F.col("r.us") - F.col("l.us"))
    value = {
        "interpolate": F.when(on, F.col("r.value")).otherwise(F.col("l.value") + (F.col("r.value") - F.col("l.value")) * share),
        "ffill": F.when(on, F.col("r.value")).otherwise(F.col("l.value")), "bfill": F.col("r.value"), "none": F.when(on, F.col("r.value")),
    }[fill]
    return x.select(*KEYS, "us", value.alias("value"))


def severity(events: DataFrame) -> DataFrame:
    """Composite severity of events(score, n_signals, seconds, critical): the label is low, medium or high."""
    total = (
        0.40 * F.col("score") + 0.25 * F.least(F.col("n_signals") / 8, F.lit(1.0)) + 0.15 * F.least(F.col("seconds") / 300, F.lit(1.0))
        + 0.20 * F.col("critical").cast("double")
    )
    return events.withColumn("composite", total).withColumn("severity", F.when(total < 0.33, "low").when(total < 0.66, "medium").otherwise("high"))


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, tie: str, width: int = DAY_US) -> DataFrame:
    """Each left row with the ``value`` of the last right row of its keys at or before it, null if none; both sides
    are ordered in ranges of ``width`` (microseconds of a time, else units of ``at``)."""
    both = left.withColumn("_side", F.lit(1)).withColumn("_value", F.lit(None).cast(right.schema[value].dataType))
    other = right.select(*keys, at, tie, F.lit(0).alias("_side"), F.col(value).alias("_value"))
    both = both.unionByName(other, allowMissingColumns=True)
    found = {"asof": F.when(F.col("_side") == 0, F.struct(F.col("_value").alias("v")))}
    return running(both, keys, at, ["_side", tie], width, lasts=found).where("_side = 1").withColumn("asof", F.col("asof.v")).drop("_side", "_value")


def overlaps(a: DataFrame, b: DataFrame, keys: list[str], bucket_us: int) -> DataFrame:
    """Pairs of intervals of the same keys with a common interior (open at both ends): an
    equi-join on the time buckets that each interval touches, every pair reported once."""

    def spread(df, p):
        buckets = F.sequence(F.floor(F.col("start_us") / bucket_us), F.floor(F.col("end_us") / bucket_us))
        return df.select(*keys, F.col("start_us").alias(f"{p}_start"), F.col("end_us").alias(f"{p}_end"), F.explode(buckets).alias("bucket"))

    pairs = spread(a, "a").join(spread(b, "b"), [*keys, "bucket"])
    pairs = pairs.where((F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end")))
    return pairs.where(F.col("bucket") == F.floor(F.greatest("a_start", "b_start") / bucket_us)).drop("bucket")
