"""Exact percentiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.streaming.live import folder


def percentiles(rows: DataFrame, keys: list[str], value: str, levels: dict[str, float]) -> DataFrame:
    """(keys, n, one column per name of ``levels``): linear percentiles, exact, of each key's values.

    Values are counted, the counts ordered by (keys, value) over all tasks and written in the shared folder with their range's number.
    Ranges are summed up by key, the sums scanned over ranges, and within each range the ranks go on from there: no task holds or orders
    a key's values, only those of one range. Null and NaN values are left out, a key with no others has no row, null keys are a key,
    infinite values are ordered like others, and an empty table gives an empty result.
    """
    for name, p in levels.items():
        if not 0 <= p <= 1:
            raise ValueError(f"level {name} must be within 0 and 1")
    v = F.col(value).cast("double")
    counts = rows.select(*keys, v.alias("_value")).where(F.col("_value").isNotNull() & ~F.isnan("_value")).groupBy(*keys, "_value").agg(F.count("*").alias("_n"))
    path = folder(rows.sparkSession, "percentiles")
    counts.repartitionByRange(*keys, "_value").withColumn("_range", F.spark_partition_id()).write.parquet(path)
    ranged = rows.sparkSession.read.parquet(path)

    sums = ranged.groupBy("_range", *keys).agg(F.sum("_n").alias("_held"))
    over_ranges = Window.partitionBy(*keys).orderBy("_range")  # one row per range that a key reaches into
    sums = sums.withColumn("_before", F.sum("_held").over(over_ranges) - F.col("_held")).withColumn("_total", F.sum("_held").over(Window.partitionBy(*keys)))
    sums = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), "_before", "_total")
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    within = Window.partitionBy("_range", *keys).orderBy("_value")
    x = ranged.join(sums, same).withColumn("_last", F.col("_before") + F.sum("_n").over(within) - 1).withColumn("_first", F.col("_last") - F.col("_n") + 1)

    def at(rank):
        return F.max(F.when((F.col("_first") <= rank) & (rank <= F.col("_last")), F.col("_value")))

    picked, out = [F.first("_total").alias("n")], []
    for i, (name, p) in enumerate(levels.items()):
        place = (F.col("_total") - 1) * F.lit(float(p))
        picked += [at(F.floor(place)).alias(f"_lo{i}"), at(F.ceil(place)).alias(f"_hi{i}")]
        lo, hi, share = F.col(f"_lo{i}"), F.col(f"_hi{i}"), (F.col("n") - 1) * F.lit(float(p)) % 1
        out.append(F.when(lo == hi, lo).otherwise(lo * (1 - share) + hi * share).alias(name))
    return x.groupBy(*keys).agg(*picked).select(*keys, "n", *out)
