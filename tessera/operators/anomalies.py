"""Anomaly events: contexts, severity, merging, and the heuristics of plain summaries.

An event is (session, start_us, end_us, signals array, pattern, context, severity, detector, score).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.statistics import KEYS, by_time, valid

# Signals that add to an event's severity.
CRITICAL = (
    "engine_rpm", "vehicle_speed", "coolant_temperature", "short_fuel_trim_1", "long_fuel_trim_1", "engine_load", "throttle_position", "mass_airflow",
)
# Thresholds of driving contexts.
RPM_OFF, SPEED_MOVING, THROTTLE_STEADY = 50, 5, 3.0
# Typical operating ranges.
OPERATING_RANGES = {
    "RPM": (0.0, 8000.0), "COOLANT_TEMP": (-40.0, 110.0), "SHORT_FUEL_TRIM_1": (-25.0, 25.0), "LONG_FUEL_TRIM_1": (-25.0, 25.0),
    "INTAKE_PRESSURE": (0.0, 255.0), "SPEED": (0.0, 250.0), "THROTTLE_POS": (0.0, 100.0), "ENGINE_LOAD": (0.0, 100.0),
}


def composite(score: Column, n_signals: Column, seconds: Column, critical: Column) -> Column:
    """G15."""
    return 0.40 * score + 0.25 * F.least(n_signals / 8, F.lit(1.0)) + 0.15 * F.least(seconds / 300, F.lit(1.0)) + 0.20 * critical.cast("double")


def label(total: Column) -> Column:
    return F.when(total < 0.33, "low").when(total < 0.66, "medium").otherwise("high")


def with_severity(events: DataFrame, critical: tuple = CRITICAL) -> DataFrame:
    total = composite(F.col("score"), F.size("signals"), (F.col("end_us") - F.col("start_us")) / 1e6, F.exists("signals", lambda s: s.isin(*critical)))
    return events.withColumn("severity", label(total))


def driving_context(events: DataFrame, rows: DataFrame, rpm: str = "engine_rpm", speed: str = "vehicle_speed", throttle: str = "throttle_position", bucket_us: int = 3_600_000_000) -> DataFrame:
    """Each event of (session, start_us, end_us, ...) with what the vehicle did within its closed window: off, idle,
    cruise, acceleration or unknown. Rows meet the events of their session in the buckets of time that these reach into."""
    key = ["session", "start_us", "end_us"]
    spans = events.select(*key).distinct()
    windows = spans.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start_us") / bucket_us), F.floor(F.col("end_us") / bucket_us))))
    points = valid(rows.where(F.col("signal").isin(rpm, speed, throttle))).select("session", "signal", "us", "value", F.floor(F.col("us") / bucket_us).alias("bucket"))
    inside = points.join(windows, ["session", "bucket"]).where("us >= start_us AND us <= end_us")
    of = lambda name: F.when(F.col("signal") == name, F.col("value"))
    seen = inside.groupBy(*key).agg(
        F.avg(of(rpm)).alias("rpm"), F.avg(of(speed)).alias("speed"), F.count(of(throttle)).alias("n"), F.stddev_pop(of(throttle)).alias("spread"),
    )
    steady = F.when(F.col("n") >= 2, F.when(F.col("spread") <= THROTTLE_STEADY, "cruise").otherwise("acceleration"))
    context = F.when(F.col("rpm").isNull() | F.col("speed").isNull(), "unknown").when(F.col("rpm") < RPM_OFF, "off").when(F.col("speed") < SPEED_MOVING, "idle").otherwise(F.coalesce(steady, F.lit("unknown")))
    known = seen.select(*key, context.alias("context"))
    return events.drop("context").join(known, key, "left").withColumn("context", F.coalesce("context", F.lit("unknown")))


def merged(events: DataFrame, critical: tuple = CRITICAL) -> DataFrame:
    """Events of a session whose closed windows overlap become one: the signals in order of appearance, the first
    context, the detector if all agree or ``combined``, the patterns one after the other, and the score as a running
    average of two, oldest first. Only the events of one overlap are held together."""
    order = Window.partitionBy("session").orderBy("start_us", "end_us", "detector", "pattern")
    before = F.max("end_us").over(order.rowsBetween(Window.unboundedPreceding, -1))
    x = events.withColumn("opens", F.coalesce((F.col("start_us") > before).cast("int"), F.lit(1))).withColumn("run", F.sum("opens").over(order))
    row = F.struct("start_us", "end_us", "detector", "pattern", "score", "signals", "context")
    x = x.groupBy("session", "run").agg(F.array_sort(F.collect_list(row)).alias("all"))
    first, rest = F.col("all")[0], F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0)))
    one = F.forall("all", lambda e: e["detector"] == first["detector"])
    out = x.select(
        "session", first["start_us"].alias("start_us"), F.array_max(F.transform("all", lambda e: e["end_us"])).alias("end_us"),
        F.array_distinct(F.flatten(F.transform("all", lambda e: e["signals"]))).alias("signals"), F.array_join(F.transform("all", lambda e: e["pattern"]), "; ").alias("pattern"),
        first["context"].alias("context"), F.when(one, first["detector"]).otherwise("combined").alias("detector"),
        F.aggregate(rest, first["score"], lambda a, e: (a + e["score"]) / 2).alias("score"),
    )
    return with_severity(out, critical)


def plain_heuristics(rows: DataFrame, ranges: dict = OPERATING_RANGES) -> DataFrame:
    """A5: (session, signal, kind, value, other) of each finding in the values of a signal:
    ``range_shift`` (of three or more values the first is over two sample deviations from the mean: it, and the mean of
    the rest), ``out_of_range`` (the first value outside of the signal's range), and, unless the first fired,
    ``mostly_constant`` (of five or more at least nine tenths are equal, not all: that value, and how many)."""
    x = valid(rows)
    order = F.struct("us", "row_id")
    bounds = F.create_map(*[F.lit(v) for k, (lo, hi) in ranges.items() for v in (k, F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")))]) if ranges else None
    b = F.try_element_at(bounds, F.col("signal"))
    outside = (F.col("value") < b["lo"]) | (F.col("value") > b["hi"])
    s = x.groupBy(*KEYS).agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.sum("value").alias("total"), F.min_by("value", order).alias("first"),
        F.min_by(F.when(outside, F.col("value")), F.when(outside, order)).alias("odd"),
    )
    counts = x.groupBy(*KEYS, "value").agg(F.count("*").alias("c"))
    most = counts.groupBy(*KEYS).agg(F.max(F.struct("c", "value")).alias("most"))
    s = s.join(most, list(KEYS))
    shifted = (F.col("n") >= 3) & (F.col("std") > 0) & (F.abs(F.col("first") - F.col("mean")) > 2 * F.col("std"))
    shifted = F.coalesce(shifted, F.lit(False))
    constant = ~shifted & (F.col("n") >= 5) & (F.col("most.c") >= 0.9 * F.col("n")) & (F.col("most.c") < F.col("n"))
    found = F.array(
        F.when(shifted, F.struct(F.lit("range_shift").alias("kind"), F.col("first").alias("value"), ((F.col("total") - F.col("first")) / (F.col("n") - 1)).alias("other"))),
        F.when(F.col("odd").isNotNull(), F.struct(F.lit("out_of_range").alias("kind"), F.col("odd").alias("value"), F.lit(None).cast("double").alias("other"))),
        F.when(constant, F.struct(F.lit("mostly_constant").alias("kind"), F.col("most.value").alias("value"), F.col("most.c").cast("double").alias("other"))),
    )
    return s.select(*KEYS, F.explode(F.filter(found, lambda f: f.isNotNull())).alias("f")).select(*KEYS, "f.*")


def islands_of(rows: DataFrame, flag: Column) -> DataFrame:
    """rows(session, us, ...) with the number of the run of neighbouring flagged rows they are in, others left out."""
    order = Window.partitionBy("session").orderBy("us")
    x = rows.withColumn("_on", F.coalesce(flag, F.lit(False)))
    opens = F.col("_on") & ~F.coalesce(F.lag("_on").over(order), F.lit(False))
    return x.withColumn("run", F.sum(opens.cast("int")).over(order)).where("_on").drop("_on")


def top_signals(z: DataFrame, most: int = 5) -> DataFrame:
    """(session, run, signals): of z(session, run, signal, z) the signals of largest mean absolute z, the larger first."""
    means = z.groupBy("session", "run", "signal").agg(F.avg(F.abs("z")).alias("m"))
    nth = F.row_number().over(Window.partitionBy("session", "run").orderBy(F.desc("m"), "signal"))
    x = means.withColumn("nth", nth).where(F.col("nth") <= most)
    return x.groupBy("session", "run").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "signal"))), lambda s: s["signal"]).alias("signals"))
