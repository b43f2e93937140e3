"""Where queries and their SQL are registered by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with the same in DuckDB SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Floating results with six decimals: sums differ in the last bits with the order of rows."""
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in columns})
