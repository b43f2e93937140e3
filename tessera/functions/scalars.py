"""Scalar functions as columns: units, timestamps, codes, slugs, sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$"

# Conversion factors to metric units.
UNITS = {
    "fahrenheit_to_celsius": lambda v: (v - 32) * 5 / 9, "mph_to_kmh": lambda v: v * 1.60934, "inhg_to_kpa": lambda v: v * 3.38639,
    "psi_to_kpa": lambda v: v * 6.89476, "lb_min_to_g_s": lambda v: v * 7.55987, "miles_to_km": lambda v: v * 1.60934,
}

# The first letter of a trouble code names the subsystem.
SUBSYSTEMS = {"P": "powertrain", "C": "chassis", "B": "body", "U": "network"}


def number(text: Column) -> Column:
    """A double, or null for blanks, N/A and anything else that is no plain number."""
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def convert(text: Column, unit: str) -> Column:
    """A number in metric units with two decimals as text; what is no number passes through."""
    return F.when(number(text).isNotNull(), F.format_string("%.2f", F.round(UNITS[unit](number(text)), 2))).otherwise(text)


def clean_timestamp(text: Column) -> Column:
    """T becomes a space and the fraction of a second goes."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), "T", " "), "[.][0-9]+", "")


def twelve_hour(hour: Column, pm: Column) -> Column:
    """The hour of a day; 12 without the afternoon's mark is midnight."""
    return F.when(pm & (hour < 12), hour + 12).when(~pm & (hour == 12), 0).otherwise(hour)


def duration(seconds: Column) -> Column:
    return F.concat(F.floor(seconds / 60).cast("string"), F.lit("m "), (seconds % 60).cast("long").cast("string"), F.lit("s"))


def code_kind(code: Column) -> Column:
    return F.when(code.rlike("^[PCBU][0-9A-Fa-f]{4}$"), "standard").when(code.rlike("^[0-9A-Fa-f]{10,}$"), "hex").otherwise("unknown")


def code_subsystem(code: Column) -> Column:
    found = F.lit("unknown")
    for letter, name in SUBSYSTEMS.items():
        found = F.when(code.startswith(letter), name).otherwise(found)
    return F.when(code_kind(code) == "standard", found).otherwise("unknown")


def pseudonym(vin: Column) -> Column:
    return F.concat(F.lit("V-"), F.upper(F.substring(F.sha2(vin, 256), 1, 8)))


def slug(title: Column, most: int = 80) -> Column:
    """Lower case; runs of other than a-z, 0-9 and CJK letters become single dashes; none at the ends;
    more than ``most`` characters are cut at a dash, if there is one."""
    whole = F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9\u2E80-\u9FFF\uF900-\uFAFF-]+", "-"), "^-+|-+$", "")
    return F.when(F.length(whole) <= most, whole).otherwise(F.regexp_replace(F.substring(whole, 1, most), "-[^-]*$", ""))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def truncated(text: Column, most: int, mark: str = "[cut]") -> Column:
    """Three quarters of ``most`` characters from the head, the rest from the tail, with a mark between."""
    head = most * 3 // 4
    tail = most - head
    cut = F.concat(F.substring(text, 1, head), F.lit(mark), F.right(text, F.lit(tail)))
    return F.when(F.length(text) <= most, text).otherwise(cut)
