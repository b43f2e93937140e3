"""Readers of vehicle logs: five text formats to one long table.

A log file is one row (session, body); its lines, header and format are columns of
that row. Files are small and many. One window over each file's rows finds rows that
repeat the one before, which one of the formats drops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import scalars as S

# Headers of the metric-converted format, the signal each one names, and its unit conversion.
OBDWIZ = {
    "Time": ("Timestamp", None),
    "车速 (MPH)": ("SPEED", "mph_to_kmh"),
    "EGR 误差 (%)": ("EGR_ERROR", None),
    "自发动机启动以来的时间 (sec)": ("RUN_TIME", None),
    "自 DTC 清除以来的预热次数": ("WARMUPS_SINCE_DTC_CLEAR", None),
    "质量空气流量 (lb/min)": ("MAF", "lb_min_to_g_s"),
    "油门踏板位置 E (%)": ("ACCELERATOR_POS_E", None),
    "油门踏板位置 D (%)": ("ACCELERATOR_POS_D", None),
    "氧传感器的位置": ("O2_SENSORS", None),
    "相对节气门位置 (%)": ("RELATIVE_THROTTLE_POS", None),
    "节气门位置 B (%)": ("THROTTLE_POS_B", None),
    "当距离行程 (以MIL亮为准) (miles)": ("DISTANCE_W_MIL", "miles_to_km"),
    "自 DTC 清除以来的距离 (miles)": ("DISTANCE_SINCE_DTC_CLEAR", "miles_to_km"),
    "发动机转速 (RPM)": ("RPM", None),
    "发动机冷却液温度 (°F)": ("COOLANT_TEMP", "fahrenheit_to_celsius"),
    "计算负荷值 (%)": ("ENGINE_LOAD", None),
    "正时提前 (°)": ("TIMING_ADVANCE", None),
    "进气温度 (°F)": ("INTAKE_TEMP", "fahrenheit_to_celsius"),
    "进气歧管绝对压力 (inHg)": ("INTAKE_PRESSURE", "inhg_to_kpa"),
    "大气压力 (inHg)": ("BAROMETRIC_PRESSURE", "inhg_to_kpa"),
    "节气门位置 (%)": ("THROTTLE_POS", None),
    "控制模块电压 (V)": ("CONTROL_MODULE_VOLTAGE", None),
    "绝对负荷值 (%)": ("ABSOLUTE_LOAD", None),
    "指令等效比 ()": ("COMMANDED_EQUIV_RATIO", None),
    "短时燃油修正 - 缸列 1 (%)": ("SHORT_FUEL_TRIM_1", None),
    "长时燃油修正 - 缸列 1 (%)": ("LONG_FUEL_TRIM_1", None),
    "指令蒸发清洗 (%)": ("EVAPORATIVE_PURGE", None),
    "指令 EGR (%)": ("COMMANDED_EGR", None),
    "催化转化器温度: 缸列 1, 传感器 1 (°F)": ("CATALYST_TEMP_B1S1", "fahrenheit_to_celsius"),
    "O2 传感器 2 电压 (缸列 1) (V)": ("O2_B1S2", None),
    "O2 传感器 1 电流 (缸列 1) (mA)": ("O2_S1_WR_CURRENT", None),
    "燃油系统状态": ("FUEL_STATUS", None),
    "燃油类型": ("FUEL_TYPE", None),
    "燃油轨压力（直喷） (psi)": ("FUEL_RAIL_PRESSURE_DIRECT", "psi_to_kpa"),
    "OBD 标准": ("OBD_COMPLIANCE", None),
    "节气门执行器 (%)": ("THROTTLE_ACTUATOR", None),
    "ELM 电压 (V)": ("ELM_VOLTAGE", None),
}

# Columns of the dual-channel format that have a standard name.
DUAL = {
    "Timestamp": "Timestamp", "A_KL_RPM": "RPM", "A_KL_SPEED": "SPEED", "A_KL_COOLANT_TEMP": "COOLANT_TEMP", "A_KL_IAT": "INTAKE_TEMP",
    "A_KL_MAP": "INTAKE_PRESSURE", "A_KL_BARO": "BAROMETRIC_PRESSURE", "A_KL_TIMING_ADV": "TIMING_ADVANCE", "A_KL_TPS": "THROTTLE_POS",
    "A_KL_REL_TPS": "RELATIVE_THROTTLE_POS", "A_KL_ENGINE_LOAD": "ENGINE_LOAD", "A_KL_CTRL_VOLT": "CONTROL_MODULE_VOLTAGE",
}

MAXLOG_DROPPED = "^(DTC_|MONITOR_|M22_)"
HEAD_LINES = 60
_COMMA = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'  # a comma outside quotes
_CODE = "[PCBU][0-9A-Fa-f]{4}"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, body) of all files below a folder; the name without its extension names the session."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    return spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(name.alias("session_id"), F.col("value").alias("body"))


def _lookup(pairs: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


def _with_lines(files: DataFrame) -> DataFrame:
    """Adds the lines and the place (from 0) of the first that is neither blank nor a comment."""
    body = F.regexp_replace(F.coalesce("body", F.lit("")), "^﻿", "")
    x = files.select("session_id", F.split(body, "\r?\n").alias("lines"))
    used = F.transform(F.slice("lines", 1, HEAD_LINES), lambda line: (line != "") & ~line.startswith("#"))
    return x.withColumn("first", (F.array_position(used, True) - 1).cast("int"))


def sniff(files: DataFrame) -> DataFrame:
    """(session_id, format) by the first line that is neither blank nor a comment, within the first 60.

    The tests in order: a header of tabs, channel prefixes, Chinese letters, units
    in brackets, commas with a Timestamp. Anything else, as an empty file, counts as
    the native format.
    """
    x = _with_lines(files)
    header = F.when(F.col("first") >= 0, F.get("lines", F.col("first")))
    notes = F.filter(F.slice("lines", 1, F.greatest("first", F.lit(0))), lambda line: line.startswith("#"))
    dual = F.exists(notes, lambda line: F.contains(line, F.lit("Yamaha Dual")))
    comma, units = F.contains(header, F.lit(",")), header.rlike(r"\w\s+\([^)]+\)")
    kind = (
        F.when(header.isNull() | header.startswith("Timestamp\t"), "native_tsv")
        .when(header.rlike("A_KL_|A_YAM_") | (dual & comma), "yamaha_dual")
        .when(header.rlike("[一-鿿]"), "csvlog_obdwiz")
        .when(units & (comma | (F.size(notes) > 0)), "obd_maxlog")
        .when(comma & F.contains(header, F.lit("Timestamp")), "generic_csv")
        .otherwise("native_tsv")
    )
    return x.select("session_id", "lines", "first", kind.alias("format"))


def _cells(line: Column, native: Column) -> Column:
    plain = F.when(native, F.split(line, "\t")).otherwise(F.transform(F.split(line, _COMMA), lambda c: F.regexp_replace(c, '^"|"$', "")))
    return F.transform(plain, lambda c: F.trim(F.replace(c, F.lit("\u0000"), F.lit(""))))


def _chinese_time(raw: Column) -> Column:
    """Month first, twelve hours with a mark for the afternoon, fraction of a second dropped."""
    pm = F.contains(raw, F.lit("下午"))
    text = F.regexp_replace(F.trim(F.regexp_replace(raw, r"\s*(上午|下午)\s*$", "")), r"[.][^.]*$", "")
    at = F.coalesce(F.try_to_timestamp(text, F.lit("MM/dd/yyyy HH:mm:ss")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")))
    shift = S.twelve_hour(F.hour(at), pm) - F.hour(at)
    return F.timestamp_seconds(F.unix_seconds(at) + shift * 3600)


def rows(files: DataFrame, all_channels: bool = False) -> DataFrame:
    """(session_id, format, row_id, ts, signal, raw, value): every cell but the time's, of any format.

    ``row_id`` counts a file's data lines from 0. Lines with fewer cells than the
    native header are dropped, as are rows whose time can't be read; nothing is
    put in its place. ``value`` is null where the cell is no number. A file without
    a header gives no rows; null bodies count as empty. ``all_channels`` keeps the
    channels without a standard name.
    """
    x = sniff(files)
    native = F.col("format") == "native_tsv"
    tab = F.array_position(F.transform("lines", lambda line: line.startswith("Timestamp\t")), True) - 1
    x = x.withColumn("at", F.when(native, tab).otherwise(F.col("first")).cast("int")).where("at >= 0")
    names = F.filter(_cells(F.get("lines", F.col("at")), native), lambda c: ~native | (c != ""))
    x = x.withColumn("names", names)
    start = F.col("at") + 2 + native.cast("int")  # slice counts from 1; the native header has a rule below it
    data = F.filter(F.slice("lines", start, F.greatest(F.size("lines") - start + 1, F.lit(0))), lambda line: (F.trim(line) != "") & ~(native & line.rlike("^(---|Log )")))
    data = F.filter(data, lambda line: ~line.rlike("^[,\\s]*$") | native)
    x = x.select("session_id", "format", "names", F.posexplode(data).alias("row_id", "line"))
    x = x.withColumn("cells", _cells(F.col("line"), native)).where(~native | (F.size("cells") >= F.size("names")))

    def signal(name: Column) -> Column:
        kept = F.lit(None) if not all_channels else name
        return (
            F.when(F.col("format") == "csvlog_obdwiz", _lookup({k: v[0] for k, v in OBDWIZ.items()}, name))
            .when(F.col("format") == "yamaha_dual", F.coalesce(_lookup(DUAL, name), kept))
            .when(F.col("format") == "obd_maxlog", F.when(~name.rlike(MAXLOG_DROPPED), F.regexp_replace(name, r"\s*\([^)]*\)\s*$", "")))
            .otherwise(name)
        )

    pairs = F.transform("names", lambda name, k: F.struct(signal(name).alias("signal"), F.coalesce(F.get("cells", k), F.lit("")).alias("raw"), name.alias("name")))
    x = x.withColumn("pairs", F.filter(pairs, lambda p: p["signal"].isNotNull()))
    is_time = lambda p: p["signal"] == "Timestamp"
    x = x.withColumn("time", F.get(F.filter("pairs", is_time), F.lit(0))["raw"]).withColumn("pairs", F.filter("pairs", lambda p: ~is_time(p)))
    # one format repeats rows: those equal to the row before go
    order = Window.partitionBy("session_id").orderBy("row_id")
    repeated = (F.col("format") == "csvlog_obdwiz") & F.coalesce(F.lag("pairs").over(order) == F.col("pairs"), F.lit(False))
    x = x.withColumn("repeated", repeated).where("NOT repeated").drop("repeated")
    plain_time = F.try_to_timestamp(F.regexp_replace(F.replace("time", F.lit("T"), F.lit(" ")), r"[.][^.]*$", ""), F.lit("yyyy-MM-dd HH:mm:ss"))
    x = x.withColumn("ts", F.when(F.col("format") == "csvlog_obdwiz", _chinese_time(F.col("time"))).otherwise(plain_time)).where("ts IS NOT NULL")
    x = x.select("session_id", "format", F.col("row_id").cast("long").alias("row_id"), "ts", F.explode("pairs").alias("p")).select("*", "p.*").drop("p")
    unit = F.when(F.col("format") == "csvlog_obdwiz", _lookup({k: v[1] for k, v in OBDWIZ.items() if v[1]}, F.col("name")))
    raw = F.col("raw")
    for kind in S.UNITS:
        raw = F.when(unit == kind, S.convert(F.col("raw"), kind)).otherwise(raw)
    return x.withColumn("raw", raw).select("session_id", "format", "row_id", "ts", "signal", "raw", S.number(F.col("raw")).alias("value"))


def trouble_codes(long: DataFrame) -> DataFrame:
    """(session_id, code, status, first_row): the codes of the code columns; a stored code hides a pending one."""
    status = _lookup({"GET_DTC": "stored", "GET_CURRENT_DTC": "pending"}, F.col("signal"))
    x = long.withColumn("status", status).where("status IS NOT NULL")
    x = x.select("session_id", "row_id", "status", F.explode(F.regexp_extract_all("raw", F.lit(_CODE), F.lit(0))).alias("code")).withColumn("code", F.upper("code"))
    return x.groupBy("session_id", "code").agg(F.max("status").alias("status"), F.min("row_id").alias("first_row"))


def vehicle(files: DataFrame) -> DataFrame:
    """(session_id, vehicle_id): a ``# vehicle_id:`` line within the first 4,096 characters, or null."""
    found = F.regexp_extract(F.substring("body", 1, 4096), r"(?m)^#\s*vehicle_id:\s*(\S.*?)\s*$", 1)
    return files.select("session_id", F.nullif(found, F.lit("")).alias("vehicle_id"))
