"""The driver's tables in the roles of the signal model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session, signal, ts, us, row_id, value): the events table as a long signal log; us is ts in microseconds."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("user_id").alias("session"), F.col("event_type").alias("signal"), "ts",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").alias("row_id"), "value",
    )
