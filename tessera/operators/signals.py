"""Tools over the signals of a session: inventory, names, windows, sampling, event caps."""

from __future__ import annotations

from fnmatch import translate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.statistics import KEYS, by_time

# Names of standard signals without a prefix, all of the engine.
STANDARD = (
    "RPM", "SPEED", "COOLANT_TEMP", "INTAKE_TEMP", "IAT", "MAP", "BARO", "BAROMETRIC_PRESSURE", "ENGINE_LOAD", "ABSOLUTE_LOAD", "THROTTLE_POS",
    "THROTTLE_POS_B", "RELATIVE_THROTTLE_POS", "TIMING_ADVANCE", "MAF", "FUEL_RAIL_PRESSURE_DIRECT", "SHORT_FUEL_TRIM_1", "LONG_FUEL_TRIM_1",
    "O2_B1S2", "O2_S1_WR_CURRENT", "CONTROL_MODULE_VOLTAGE", "ELM_VOLTAGE", "ACCELERATOR_POS_D", "ACCELERATOR_POS_E", "RUN_TIME", "DISTANCE_W_MIL",
    "DISTANCE_SINCE_DTC_CLEAR", "COMMANDED_EQUIV_RATIO",
)
# Units of the dual-channel format's signals.
UNITS = {
    "A_KL_RPM": "rpm", "A_KL_SPEED": "km/h", "A_KL_COOLANT_TEMP": "°C", "A_KL_IAT": "°C", "A_KL_MAP": "kPa", "A_KL_BARO": "kPa", "A_KL_TIMING_ADV": "deg",
    "A_KL_TPS": "%", "A_KL_REL_TPS": "%", "A_KL_ENGINE_LOAD": "%", "A_KL_CTRL_VOLT": "V", "A_YAM_BARO_REF": "kPa", "A_YAM_BATT_V": "V", "A_YAM_CHT": "°C",
    "A_YAM_ECT": "°C", "A_YAM_IAT": "°C", "A_YAM_IGN": "deg", "A_YAM_INJ_MS": "ms", "A_YAM_INJ_US": "us", "A_YAM_ISC": "step", "A_YAM_RPM": "rpm", "A_YAM_VVA": "deg",
    "A_YAM_BATT_RAW": "raw", "A_YAM_MAP_RAW": "raw", "A_YAM_O2_FB_RAW": "raw", "A_YAM_TPS_RAW": "raw",
}

# Units of the standard signals, as their logs name them.
STANDARD_UNITS = {
    "RPM": "rpm", "SPEED": "km/h", "THROTTLE_POS": "percent", "THROTTLE_POS_B": "percent", "ENGINE_LOAD": "percent", "ABSOLUTE_LOAD": "percent",
    "RELATIVE_THROTTLE_POS": "percent", "THROTTLE_ACTUATOR": "percent", "COOLANT_TEMP": "degC", "INTAKE_TEMP": "degC", "CATALYST_TEMP_B1S1": "degC", "MAF": "g/s",
    "INTAKE_PRESSURE": "kPa", "BAROMETRIC_PRESSURE": "kPa", "FUEL_RAIL_PRESSURE_DIRECT": "kPa", "SHORT_FUEL_TRIM_1": "percent", "LONG_FUEL_TRIM_1": "percent",
    "TIMING_ADVANCE": "degree", "O2_B1S2": "volt", "O2_S1_WR_CURRENT": "mA", "EGR_ERROR": "percent", "COMMANDED_EGR": "percent", "EVAPORATIVE_PURGE": "percent",
    "RUN_TIME": "second", "WARMUPS_SINCE_DTC_CLEAR": "count", "DISTANCE_W_MIL": "km", "DISTANCE_SINCE_DTC_CLEAR": "km", "CONTROL_MODULE_VOLTAGE": "volt",
    "ELM_VOLTAGE": "volt", "ACCELERATOR_POS_D": "percent", "ACCELERATOR_POS_E": "percent", "COMMANDED_EQUIV_RATIO": "ratio",
}


def subsystem(name: Column) -> Column:
    """F13."""
    return (
        F.when(name.startswith("A_KL_") | name.startswith("A_YAM_"), "engine").when(name.startswith("B_"), "abs").when(F.upper(name).isin(*STANDARD), "engine").otherwise("other")
    )


def unit(name: Column, units: dict = UNITS | STANDARD_UNITS) -> Column:
    """a signal's unit, or unknown. Names count as they are written; a null name's unit is unknown."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in units.items() for v in kv]), name), F.lit("unknown"))


def matching(inventory: DataFrame, pattern: str | None = None, of: str = "all") -> DataFrame:
    """Signals whose name fits a shell pattern, case aside, of one subsystem or all."""
    x = inventory if of == "all" else inventory.where(subsystem(F.col("signal")) == of)
    return x.where(F.lower("signal").rlike("^" + translate(pattern.lower()))) if pattern else x


def resolved(requests: DataFrame, inventory: DataFrame) -> DataFrame:
    """requests(session, name) with the signal of inventory(session, signal) they mean: the same name, the same but
    for case, or the shortest that ends with it; null if none. ``inventory`` has each signal of a session once."""
    x = requests.join(inventory, "session")
    name, own = F.upper("name"), F.upper("signal")
    rank = F.when(F.col("name") == F.col("signal"), 0).when(name == own, 1).when((name != "") & own.endswith(name), 2)
    best = F.min_by(F.when(rank.isNotNull(), F.col("signal")), F.when(rank.isNotNull(), F.struct(rank, F.when(rank == 2, F.length("signal")).otherwise(0), F.col("signal"))))
    return requests.join(x.groupBy("session", "name").agg(best.alias("signal")), ["session", "name"], "left")


def suggestions(requests: DataFrame, inventory: DataFrame, most: int = 3) -> DataFrame:
    """(session, name, nth, signal): the signals most like a name that is none: those that contain it, then those that
    share most different letters with it, the shorter first; without any, the first in order of name."""
    letters = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), ""), lambda x: x != ""))
    x = requests.join(inventory, "session").withColumn("shared", F.size(F.array_intersect(letters("signal"), letters("name"))))
    inside = (F.col("name") != "") & F.contains(F.lower("signal"), F.lower("name"))
    x = x.withColumn("score", F.when(inside, 0).when(F.col("shared") > 0, 10 - F.col("shared")))
    some = F.max(F.col("score").isNotNull()).over(Window.partitionBy("session", "name"))
    x = x.withColumn("some", some).where("score IS NOT NULL OR NOT some")
    order = Window.partitionBy("session", "name").orderBy("score", F.when(F.col("some"), F.length("signal")), "signal")
    return x.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).select("session", "name", "nth", "signal")


def checked_windows(windows: DataFrame, rows: DataFrame) -> DataFrame:
    """windows(session, window_id, start_us, end_us) with what is wrong with them, if anything: ``inverted``,
    ``outside`` (no overlap with the session's rows), ``no data`` (the session has no rows), else ``ok``. A missing bound is open."""
    span = rows.groupBy("session").agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    x = windows.join(span, "session", "left")
    state = F.when(F.col("lo").isNull(), "no data").when(F.col("start_us") > F.col("end_us"), "inverted").when((F.col("end_us") < F.col("lo")) | (F.col("start_us") > F.col("hi")), "outside")
    return x.select("session", "window_id", "start_us", "end_us", F.coalesce(state, F.lit("ok")).alias("state"))


def within(rows: DataFrame, windows: DataFrame, bucket_us: int = 86_400_000_000) -> DataFrame:
    """P5: rows in each closed window of windows(session, window_id, start_us, end_us), both bounds given."""
    reached = F.explode(F.sequence(F.floor(F.col("start_us") / bucket_us), F.floor(F.col("end_us") / bucket_us)))
    near = windows.where("start_us <= end_us").withColumn("bucket", reached)
    return rows.withColumn("bucket", F.floor(F.col("us") / bucket_us)).join(near, ["session", "bucket"]).where("us >= start_us AND us <= end_us").drop("bucket")


def every_nth(rows: DataFrame, n: int) -> DataFrame:
    """Each nth row of a series, the first included."""
    return rows.withColumn("_k", F.row_number().over(by_time()) - 1).where(F.col("_k") % n == 0).drop("_k")


def variable_signals(rows: DataFrame) -> DataFrame:
    """(session, signal) of series with two different valid values or more."""
    return rows.groupBy(*KEYS).agg(F.min(F.nanvl("value", F.lit(None))).alias("lo"), F.max(F.nanvl("value", F.lit(None))).alias("hi")).where("lo < hi").select(*KEYS)


def first_events(events: DataFrame, most: int) -> DataFrame:
    """The first ``most`` events of each series."""
    nth = F.row_number().over(Window.partitionBy(*KEYS).orderBy("start_us"))
    return events.withColumn("nth", nth).where(F.col("nth") <= most)


def by_unit(inventory: DataFrame, units: dict = UNITS | STANDARD_UNITS) -> DataFrame:
    """(session, unit, signals): a session's signals by unit, in order of name."""
    return inventory.groupBy("session", unit(F.col("signal"), units).alias("unit")).agg(F.array_sort(F.collect_set("signal")).alias("signals"))
