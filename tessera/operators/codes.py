"""Trouble codes: header lines, code columns, merging, filters and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels of channels in header lines; others are named in capitals.
CHANNELS = {"kl": "K-Line", "can": "CAN"}
# Signals worth a look for a code.
RELATED = {
    "P0117": ("COOLANT_TEMP", "IAT", "CTRL_VOLT"), "P0118": ("COOLANT_TEMP", "IAT", "CTRL_VOLT"), "P0171": ("SHORT_FUEL_TRIM_1", "LONG_FUEL_TRIM_1", "MAP", "RPM"),
    "P0174": ("SHORT_FUEL_TRIM_1", "LONG_FUEL_TRIM_1", "MAP", "RPM"), "P0300": ("RPM", "ENGINE_LOAD", "TIMING_ADVANCE"), "P0301": ("RPM", "ENGINE_LOAD"),
    "P0302": ("RPM", "ENGINE_LOAD"), "P0303": ("RPM", "ENGINE_LOAD"), "P0304": ("RPM", "ENGINE_LOAD"),
}
SUBSYSTEMS = {"P": "engine / powertrain", "C": "chassis", "B": "body", "U": "network"}
HEADER = r"^#\s*([A-Za-z]+)_(Stored|Pending)\s*:\s*([0-9A-Fa-fxX]{4,})\s*$"
PAIR = r"""\(\s*['"]([PCBU][0-9A-Fa-f]{4})['"]\s*,\s*['"](.*?)['"]\s*\)"""
CODE = "[PCBU][0-9A-Fa-f]{4}"


def family(code: Column) -> Column:
    """standard, yamaha_hex (ten hex digits or more) or unknown."""
    return F.when(F.trim(code).rlike("(?i)^[PCBU][0-9A-F]{4}$"), "standard").when(F.trim(code).rlike("^[0-9A-Fa-f]{10,}$"), "yamaha_hex").otherwise("unknown")


def _lookup(pairs: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(v) for kv in pairs.items() for v in kv]), key)


def header_codes(files: DataFrame) -> DataFrame:
    """(session_id, code, status, ecu, place) of header lines such as ``# KL_Stored: 87F1...`` in files(session_id, body)."""
    x = files.select("session_id", F.posexplode(F.split("body", "\r?\n")).alias("place", "line")).withColumn("line", F.trim("line")).where(F.col("line").rlike(HEADER))
    part = lambda k: F.regexp_extract("line", HEADER, k)
    return x.select("session_id", F.upper(part(3)).alias("code"), F.lower(part(2)).alias("status"), F.coalesce(_lookup(CHANNELS, F.lower(part(1))), F.upper(part(1))).alias("ecu"), "place")


def code_pairs(cell: Column) -> Column:
    """the (code, description) pairs of a cell such as ``[('P0301', 'Misfire')]``; without any pair, codes alone."""
    codes, texts = F.regexp_extract_all(cell, F.lit(PAIR), F.lit(1)), F.regexp_extract_all(cell, F.lit(PAIR), F.lit(2))
    pairs = F.zip_with(codes, texts, lambda c, t: F.struct(F.upper(c).alias("code"), F.nullif(t, F.lit("")).alias("description")))
    alone = F.transform(F.regexp_extract_all(cell, F.lit(CODE), F.lit(0)), lambda c: F.struct(F.upper(c).alias("code"), F.lit(None).cast("string").alias("description")))
    return F.when(F.size(codes) > 0, pairs).otherwise(alone)


def column_codes(long: DataFrame) -> DataFrame:
    """(session_id, code, status, ecu, description, place) of the cells(session_id, row_id, signal, raw) of code columns:
    each code once, at its first row, with its first description; a stored code hides a pending one."""
    status = _lookup({"GET_DTC": "stored", "GET_CURRENT_DTC": "pending"}, F.col("signal"))
    x = long.withColumn("status", status).where("status IS NOT NULL").select("session_id", "row_id", "status", F.explode(code_pairs(F.col("raw"))).alias("p"))
    x = x.select("session_id", "row_id", "status", "p.code", "p.description")
    first = F.min_by("description", F.struct((F.col("status") == "pending"), F.col("row_id")))
    return x.groupBy("session_id", "code").agg(F.max("status").alias("status"), F.lit("engine").alias("ecu"), first.alias("description"), F.min("row_id").alias("place"))


def merged(header: DataFrame, columns: DataFrame) -> DataFrame:
    """The codes of both sources, each (code, status) once; that of the header lines comes first."""
    both = header.withColumn("source", F.lit(0)).unionByName(columns.withColumn("source", F.lit(1)), allowMissingColumns=True)
    return both.groupBy("session_id", "code", "status").agg(F.min_by(F.struct("ecu", "description", "source", "place"), F.struct("source", "place")).alias("r")).select("session_id", "code", "status", "r.*")


def filtered(codes: DataFrame, status: str = "all", ecu: str = "all") -> DataFrame:
    """P10: codes of one status, and of the ``engine`` or ``abs`` unit by what its label says."""
    x = codes if status == "all" else codes.where(F.col("status") == status)
    label = F.lower(F.coalesce("ecu", F.lit("")))
    wanted = {"engine": ("k-line", "engine"), "abs": ("can", "abs")}.get(ecu)
    return x if wanted is None else x.where(F.contains(label, F.lit(wanted[0])) | F.contains(label, F.lit(wanted[1])))


def looked_up(asked: DataFrame, catalog: DataFrame) -> DataFrame:
    """asked(code, ...) with the catalog(code, description)'s text, related signals and the subsystem of standard codes."""
    related = F.create_map(*[v for k, names in RELATED.items() for v in (F.lit(k), F.array(*[F.lit(n) for n in names]))])
    of = F.when(family(F.col("code")) == "standard", _lookup(SUBSYSTEMS, F.upper(F.substring("code", 1, 1))))
    return asked.join(catalog, "code", "left").withColumn("related", F.coalesce(F.try_element_at(related, F.upper("code")), F.array().cast("array<string>"))).withColumn("subsystem", F.coalesce(of, F.lit("unknown")))
