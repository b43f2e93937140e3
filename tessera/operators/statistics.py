"""Per-signal statistics. All take (session, signal, us, row_id, value) rows and ignore null and NaN values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("session", "signal")
BINS = 10


def by_time(*keys: str):
    return Window.partitionBy(*(keys or KEYS)).orderBy("us", "row_id")


def valid(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("value").isNotNull() & ~F.isnan("value"))


def mean_of_duplicates(rows: DataFrame) -> DataFrame:
    """One row per timestamp: the mean of its values, the smallest row_id."""
    return valid(rows).groupBy(*KEYS, "us").agg(F.avg("value").alias("value"), F.min("row_id").alias("row_id"))


def profile(rows: DataFrame) -> DataFrame:
    """Fifteen statistics per session and signal, over rows in time order.

    Standard deviation is that of the population, percentiles are linear, energy is
    the mean square, autocorrelation is Pearson's between neighbours (null below three
    rows or without variance), entropy is in bits over ten equal bins (0 if constant,
    null below two rows).
    """
    x = valid(rows).withColumn("before", F.lag("value").over(by_time()))
    extent = Window.partitionBy(*KEYS)
    x = x.withColumn("lo", F.min("value").over(extent)).withColumn("hi", F.max("value").over(extent))
    at = F.floor(F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo")) * BINS)
    x = x.withColumn("bin", F.when(F.col("hi") > F.col("lo"), F.least(at, F.lit(BINS - 1))).otherwise(0))
    change = F.abs(F.col("value") - F.col("before"))
    counts = [F.count(F.when(F.col("bin") == k, 1)) for k in range(BINS)]
    n = F.count("value")
    share = [c / n for c in counts]
    bits = sum((F.when(p > 0, -p * F.log2(p)).otherwise(0.0) for p in share[1:]), F.when(share[0] > 0, -share[0] * F.log2(share[0])).otherwise(0.0))
    levels = [5, 25, 50, 75, 95]
    # not corr(), which fails where there is no variance
    after = F.when(F.col("before").isNotNull(), F.col("value"))
    pearson = F.try_divide(F.covar_pop("before", "value"), F.stddev_pop(after) * F.stddev_pop("before"))
    out = x.groupBy(*KEYS).agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.percentile("value", F.array(*[F.lit(p / 100) for p in levels])).alias("levels"),
        F.when(n >= 3, pearson).alias("autocorrelation"),
        F.avg(change).alias("mean_abs_change"), F.max(change).alias("max_abs_change"),
        F.avg(F.col("value") * F.col("value")).alias("energy"), F.when(n >= 2, bits).alias("entropy"), n.alias("valid_count"),
    )
    return out.withColumns({f"p{p}": F.col("levels")[k] for k, p in enumerate(levels)}).drop("levels")


def window_stats(rows: DataFrame) -> DataFrame:
    """Basic, trend and extrema statistics per session and signal over raw rows: slope per
    sample index by least squares, lag-1 autocorrelation about the global mean and variance,
    first and last value, and when minimum and maximum first occur."""
    extent = Window.partitionBy(*KEYS)
    x = valid(rows).withColumn("k", (F.row_number().over(by_time()) - 1).cast("double")).withColumn("mu", F.avg("value").over(extent))
    x = x.withColumn("before", F.lag("value").over(by_time()))
    n = F.count("value")
    product = F.sum((F.col("value") - F.col("mu")) * (F.col("before") - F.col("mu")))
    return x.groupBy(*KEYS).agg(
        n.alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.when(n >= 2, F.covar_pop("k", "value") / F.nullif(F.var_pop("k"), F.lit(0.0))).alias("slope"),
        F.when((n >= 3) & (F.var_pop("value") > 0), product / ((n - 1) * F.var_pop("value"))).alias("autocorrelation"),
        F.min_by("value", F.col("k")).alias("first"), F.max_by("value", F.col("k")).alias("last"),
        F.min_by("us", F.struct("value", "us")).alias("min_at"), F.max_by("us", F.struct("value", -F.col("us"))).alias("max_at"),
    )


def box_plot(profiles: DataFrame) -> DataFrame:
    """Base, box and whiskers of each profile."""
    return profiles.select(
        *KEYS, F.col("p25").alias("base"), (F.col("p75") - F.col("p25")).alias("iqr"),
        (F.col("p25") - F.col("p5")).alias("low_whisker"), (F.col("p95") - F.col("p75")).alias("high_whisker"),
    )


def density(rows: DataFrame, usable: Column) -> DataFrame:
    """Share of usable values per signal, and a label for it."""
    out = rows.groupBy("signal").agg(F.count("*").alias("total"), F.count(F.when(usable, 1)).alias("valid"))
    share = F.col("valid") / F.col("total")
    percent = F.concat(F.lit(" ("), F.floor(100 * F.col("valid") / F.col("total")).cast("string"), F.lit("%)"))
    label = F.when(F.col("valid") == 0, "all N/A").when(share >= 0.99, "dense").when(share >= 0.5, F.concat(F.lit("sparse"), percent)).otherwise(F.concat(F.lit("very sparse"), percent))
    return out.withColumn("density", share).withColumn("label", label)


def z_scores(rows: DataFrame) -> DataFrame:
    """Value minus mean over population standard deviation per session and signal; a deviation of zero counts as one."""
    extent = Window.partitionBy(*KEYS)
    std = F.stddev_pop("value").over(extent)
    return valid(rows).withColumn("z", (F.col("value") - F.avg("value").over(extent)) / F.when(std > 0, std).otherwise(1.0))


def dominant_value(rows: DataFrame, key: str, value: Column, least: float = 0.9) -> DataFrame:
    """Each key's most common value (the smaller on a tie), its share, and whether that is ``least`` or more."""
    counts = rows.groupBy(key, value.alias("common")).agg(F.count("*").alias("n"))
    out = counts.groupBy(key).agg(F.sum("n").alias("total"), F.max("n").alias("n"), F.min_by("common", F.struct(-F.col("n"), "common")).alias("common"))
    return out.withColumn("share", F.col("n") / F.col("total")).withColumn("dominant", F.col("share") >= least)


def report(grades: DataFrame, lane: str, score: str, cut: float = 0.7) -> DataFrame:
    """Per lane: n, mean, median, sample deviation, range, and the share of scores that pass."""
    return grades.groupBy(lane).agg(
        F.count(score).alias("n"), F.avg(score).alias("mean"), F.percentile(score, F.lit(0.5)).alias("median"), F.stddev_samp(score).alias("std"),
        F.min(score).alias("min"), F.max(score).alias("max"), F.avg((F.col(score) >= cut).cast("double")).alias("pass_rate"),
    )
