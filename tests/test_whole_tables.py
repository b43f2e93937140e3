"""Queries over whole tables against brute force on fixtures."""

import datetime

from tessera.queries import QUERIES


def test_part_overlaps_take_all_quantities(spark, tmp_path):
    day = datetime.timedelta(days=1)
    first = datetime.date(1995, 1, 1)
    lines = [(part, 1 + part % 2, line, quantity, first + k * day) for part in (1, 2) for line in (1, 2, 3) for k, quantity in ((0, 1.0), (2, 44.0), (3, 50.0), (9, 7.0))]
    rows = spark.createDataFrame(lines, "l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_shipdate date")
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {(r["l_partkey"], r["l_suppkey"], r["a_start"], r["b_start"]) for r in QUERIES["part_interval_overlaps"](spark, str(tmp_path)).collect()}
    us = lambda d: (d - datetime.date(1970, 1, 1)).days * 86_400_000_000
    want = {
        (a[0], a[1], us(a[4]), us(b[4])) for a in lines for b in lines
        if a[:2] == b[:2] and (a[2], b[2]) == (1, 2) and a[4] < b[4] + 3 * day and b[4] < a[4] + 2 * day
    }
    assert got == want and len(want) > 8


def test_slugs_take_the_whole_text(spark, tmp_path):
    spark.createDataFrame([(1, "é" * 120 + " Late Words")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert QUERIES["text_slugs"](spark, str(tmp_path)).first()["slug"] == "late-words"
