"""Known answers and edge cases of the analytics operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.operators import detectors, events, relational, signals, statistics

SCHEMA = "session long, signal string, us long, row_id long, value double"


def series(spark, values, step=1_000_000):
    return spark.createDataFrame([(1, "a", k * step, k, v if v is None else float(v)) for k, v in enumerate(values)], SCHEMA)


def test_profile_constant(spark):
    r = statistics.profile(series(spark, [5.0] * 100)).first()
    assert (r["mean"], r["std"], r["energy"], r["entropy"], r["autocorrelation"], r["valid_count"]) == (5, 0, 25, 0, None, 100)


def test_profile_ramp(spark):
    r = statistics.profile(series(spark, [float(k) for k in range(1, 11)])).first()
    assert (r["mean"], r["p50"], r["mean_abs_change"], r["max_abs_change"]) == (5.5, 5.5, 1, 1)
    assert r["entropy"] == pytest.approx(np.log2(10))


def test_profile_single_and_nulls(spark):
    r = statistics.profile(series(spark, [42.0, None, float("nan")])).first()
    assert r["valid_count"] == 1 and r["mean_abs_change"] is None and r["entropy"] is None
    assert statistics.profile(series(spark, [])).count() == 0


def test_events_merge_after_duration_filter(spark):
    rows = series(spark, [0, 9, 9, 0, 9, 0, 0, 0, 0, 0, 0, 0, 0, 9, 9, 9.5])
    got = events.find_events(rows, "above", 5.0, min_seconds=1.0, merge_seconds=5.0).orderBy("start_us").collect()
    assert [(r["start_us"] // 10**6, r["end_us"] // 10**6, r["peak"]) for r in got] == [(1, 2, 9), (13, 15, 9.5)]


def test_crossing_needs_a_value_before(spark):
    rows = series(spark, [1, 9, 1, None, 9])
    assert events.find_events(rows, "rising_above", 5.0, min_seconds=0.0, merge_seconds=0.0).count() == 1
    assert events.find_events(rows, "missing", min_seconds=0.0).count() == 1


def test_resample(spark):
    rows = spark.createDataFrame([(1, "a", 0, 0, 0.0), (1, "a", 4, 1, 8.0), (1, "a", 5, 2, 9.0)], SCHEMA)
    got = [r["value"] for r in events.resample(rows, 2).orderBy("us").collect()]
    assert got == [0.0, 4.0, 8.0]
    assert [r["value"] for r in events.resample(rows, 2, "bfill").orderBy("us").collect()] == [0.0, 8.0, 8.0]
    assert [r["value"] for r in events.resample(rows, 2, "none").orderBy("us").collect()] == [0.0, None, 8.0]


def test_read_window_keeps_the_ends(spark):
    got = events.read_window(series(spark, [float(k) for k in range(100)]), 10_000_000, 89_000_000, 7).orderBy("us").collect()
    assert got[0]["value"] == 10 and got[-1]["value"] == 89 and len(got) in (7, 8)


def test_pelt_finds_a_shift():
    x = np.concatenate([np.zeros(40), np.ones(40)]) + np.random.default_rng(0).normal(0, 0.05, 80)
    assert detectors.pelt((x - x.mean()) / x.std()) == [40]


def test_isolation_forest_finds_the_outlier():
    x = np.random.default_rng(0).normal(0, 1, (100, 3))
    x[17] = 12
    assert detectors.isolation_scores(x).argmax() == 17


def test_scalars(spark):
    df = spark.createDataFrame([("212",), ("N/A",), (" 1e2 ",), ("1d",), (None,)], "v string")
    got = [r[0] for r in df.select(scalars.convert(F.col("v"), "fahrenheit_to_celsius")).collect()]
    assert got == ["100.00", "N/A", "37.78", "1d", None]
    codes = spark.createDataFrame([("P0301",), ("U0100",), ("0123456789AB",), ("x",)], "c string")
    assert [tuple(r) for r in codes.select(scalars.code_kind(F.col("c")), scalars.code_subsystem(F.col("c"))).collect()] == [
        ("standard", "powertrain"), ("standard", "network"), ("hex", "unknown"), ("unknown", "unknown"),
    ]


def test_upsert(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "k long, v string")
    assert sorted(map(tuple, relational.upsert(a, b, "k").collect())) == [(1, "x"), (2, "z"), (3, "w")]


def whole_search(values):
    x = np.array(values, float)
    cuts = [0, *detectors.pelt((x - x.mean()) / x.std()), len(x)]
    return [(c, abs(x[c : c + 5].mean() - x[c - 5 : c].mean()) / np.ptp(x)) for c in cuts[1:-1]]


@pytest.mark.parametrize("shifts", [[2000], [1000, 1995, 3003], [700]])
def test_change_points_of_a_long_series(spark, shifts):
    level = np.zeros(4005)
    for n, at in enumerate(shifts):
        level[at:] += 8 if n % 2 == 0 else -5
    values = level + np.random.default_rng(1).normal(0, 1, len(level))
    got = sorted((r["at_us"] // 10**6, r["score"]) for r in detectors.change_points(series(spark, values)).collect())
    assert [k for k, _ in got] == shifts
    assert got == [(k, pytest.approx(s)) for k, s in whole_search(values)]


def test_change_points_of_each_signal(spark):
    values = [0.0] * 30 + [9.0] * 30
    rows = series(spark, [v + k % 3 / 10 for k, v in enumerate(values)])
    rows = rows.unionByName(rows.withColumn("signal", F.lit("b")).withColumn("value", F.lit(5.0)))
    got = detectors.change_points(rows).collect()
    assert [(r["signal"], r["at_us"] // 10**6) for r in got] == [("a", 30)]


def test_change_points_fill_missing_values(spark):
    values = [None, None, *([1.0, 1.2, None] * 10), *([8.0, None, 8.2] * 10)]
    filled = [1.0, 1.0]
    for v in values[2:]:
        filled.append(filled[-1] if v is None else v)
    got = sorted((r["at_us"] // 10**6, r["score"]) for r in detectors.change_points(series(spark, values)).collect())
    assert got == [(k, pytest.approx(s)) for k, s in whole_search(filled)] and len(got) == 1


def test_isolation_trees_split_the_closest_values():
    x = np.array([[1.0, 0.0], [np.nextafter(1.0, 2.0), 0.0]] * 40)
    assert len(detectors.grow(x)) == detectors.TREES and np.isfinite(detectors.isolation_scores(x)).all()


def test_isolation_forest_runs(spark):
    draw = np.random.default_rng(5)
    rows = [(1, t, *map(float, draw.normal(0, 1, 3)), 5.0) for t in range(200)] + [(2, t, 1.0, 2.0, 3.0, 5.0) for t in range(50)] + [(3, t, *map(float, draw.normal(0, 1, 3)), 5.0) for t in range(20)]
    for t in (50, 51, 52):
        rows[t] = (1, t, 9.0, -9.0, 0.1, 5.0)
    rows[0] = (1, 0, None, None, None, 5.0)
    wide = spark.createDataFrame(rows, "session long, t long, a double, b double, c double, d double")
    got = [r for r in detectors.isolation_forest(wide, "session", "t", ["a", "b", "c", "d"]).collect()]
    assert {r["session"] for r in got} == {1} and sum(r["n_rows"] for r in got) == 10
    best = max(got, key=lambda r: r["score"])
    assert (best["start"], best["end"]) == (50, 52) and set(best["signals"][:2]) == {"a", "b"} and len(best["signals"]) == 3
    assert detectors.isolation_forest(wide.limit(0), "session", "t", ["a", "b", "c", "d"]).count() == 0


def test_isolation_forests_of_pieces_score_alike(spark, monkeypatch):
    draw = np.random.default_rng(6)
    rows = [(s, t, *map(float, draw.normal(0, 1, 3))) for s in range(3) for t in range(150)]
    wide = spark.createDataFrame(rows, "session long, t long, a double, b double, c double")
    found = []
    for piece in (100_000, 40):
        monkeypatch.setattr(detectors, "PIECE", piece)
        runs = detectors.isolation_forest(wide, "session", "t", ["a", "b", "c"])
        found.append(sorted((r["session"], r["start"], r["end"], r["n_rows"], round(r["score"], 9)) for r in runs.collect()))
    assert found[0] == found[1] and found[0]


def test_resample_of_a_long_series(spark):
    rows = spark.range(100_000).selectExpr("1L AS session", "'a' AS signal", "id * 2 AS us", "id AS row_id", "cast(id AS double) AS value")
    got = events.resample(rows, 1).agg(F.count("*"), F.sum("value"), F.max("value")).first()
    assert tuple(got) == (199_999, 99_999 * 199_999 / 2, 99_999)


def test_resample_orders_rows_only(spark):
    at = [0, 3, 3 + 2 * events.GRID_RUN * 5, 7 + 2 * events.GRID_RUN * 5]
    rows = spark.createDataFrame([(1, "a", t, k, float(k)) for k, t in enumerate(at)] + [(2, "b", None, 9, 1.0), (None, "c", 4, 8, 7.0)], SCHEMA)
    out = events.resample(rows, 5, width=1000)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and "Generate" not in plan[plan.index("Exchange") :]  # the grid is made after all ordering
    got = {(r["session"], r["us"]): r["value"] for r in out.collect()}
    x = np.arange(0, at[-1] + 1, 5)
    assert got.keys() == {(1, int(t)) for t in x} | {(None, 4)} and got[None, 4] == 7.0
    assert np.allclose([got[1, int(t)] for t in x], np.interp(x, at, range(4)))
    held = {r["us"]: r["value"] for r in events.resample(rows.where("session = 1"), 5, "ffill", 1000).collect()}
    assert held == {int(t): float(np.searchsorted(at, t, "right") - 1) for t in x}


def test_units_of_standard_and_dual_channel_signals(spark):
    names = ["RPM", "SPEED", "Speed", "COOLANT_TEMP", "A_KL_COOLANT_TEMP", "A_YAM_INJ_US", "RUN_TIME", "O2_B1S2", "B_WHEEL", "", None]
    inventory = spark.createDataFrame([(1, n) for n in [*names, "RPM"]], "session long, signal string")
    got = dict(inventory.select("signal", signals.unit(F.col("signal"))).collect())
    assert got == {
        "RPM": "rpm", "SPEED": "km/h", "Speed": "unknown", "COOLANT_TEMP": "degC", "A_KL_COOLANT_TEMP": "°C", "A_YAM_INJ_US": "us", "RUN_TIME": "second",
        "O2_B1S2": "volt", "B_WHEEL": "unknown", "": "unknown", None: "unknown",
    }
    units = {r["unit"]: r["signals"] for r in signals.by_unit(inventory).collect()}
    assert units["rpm"] == ["RPM"] and units["unknown"] == ["", "B_WHEEL", "Speed"] and units["km/h"] == ["SPEED"]
    assert signals.by_unit(inventory.limit(0)).count() == 0


def test_means_of_flat_summaries_are_added_up_in_order_of_time(spark, tmp_path):
    from tessera.queries import QUERIES

    # in order of time these add up to 4, the other way round to 5: a mean of 1.33 or 1.67
    rows = [(k, 1_700_000_000 + k, 1, "view", v) for k, v in enumerate([5.0, 1e16, -1e16])]
    events = spark.createDataFrame(rows[::-1], "event_id long, t long, user_id long, event_type string, value double").coalesce(1)
    events.selectExpr("event_id", "cast(timestamp_seconds(t) AS timestamp_ntz) AS ts", "user_id", "event_type", "value").write.parquet(f"{tmp_path}/events.parquet")
    assert "mean=1.00" in QUERIES["flat_summaries"](spark, str(tmp_path)).first()["pids"]


def test_flat_summaries_add_repeated_rows_and_times_as_the_sql_does(spark, tmp_path):
    import duckdb
    from tessera.queries import ORACLE_SQL, QUERIES

    # user 1: ids against time, a sum of 4 by id and of 5 by time; user 2: one time, so that ids decide; user 3: one row three times
    sums = [5.0, 1e16, -1e16]
    rows = [(k, 9 - k, 1, "view", v) for k, v in enumerate(sums)] + [(k + 10, 5, 2, "view", v) for k, v in enumerate(sums)] + [(20, 7, 3, "view", 6.0)] * 3
    events = spark.createDataFrame(rows, "event_id long, t long, user_id long, event_type string, value double").coalesce(1)
    events.selectExpr("event_id", "cast(timestamp_seconds(t) AS timestamp_ntz) AS ts", "user_id", "event_type", "value").write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect(config={"threads": 1})
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = sorted(tuple(r) for r in QUERIES["flat_summaries"](spark, str(tmp_path)).collect())
    assert got == sorted(duck.execute(ORACLE_SQL["flat_summaries"]).fetchall()) and "mean=6.00" in got[2][3]


def test_texts_share_files_and_come_back_by_path(spark, tmp_path, monkeypatch):
    import os

    from tessera.operators import writers

    monkeypatch.setattr(writers, "TEXTS_A_FILE", 40, raising=False)
    texts = [f"text {k}" for k in range(300)] + ["ends\n\n", "", "\r\n", "a/b=c"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    moved = writers.to_files(rows, "body", F.col("id").cast("string"), str(tmp_path / "t"))
    files = [f for _, _, names in os.walk(tmp_path / "t") for f in names if f.startswith("part-")]
    assert moved.columns == ["id", "file_path"] and len(files) <= 8
    back = moved.join(spark.read.parquet(str(tmp_path / "t")), "file_path").select("id", "body")
    assert sorted(tuple(r) for r in back.collect()) == list(enumerate(texts))
    assert writers.to_files(rows.limit(0), "body", F.col("id").cast("string"), str(tmp_path / "e")).count() == 0


def test_canonical_slugs_in_tasks_of_bounded_size(spark, monkeypatch):
    from tessera.operators import filters

    claims = spark.range(1000).selectExpr("id", "1 as position", "concat('part ', id) as slug")
    known = spark.range(1000).selectExpr("id", "1 as nth", "concat('part-', id) as known")
    monkeypatch.setattr(filters, "CLAIMS_A_TASK", 50, raising=False)
    got = filters.canonical_slugs(claims, known, lambda c: F.replace(c, F.lit(" "), F.lit("-")))
    assert got.rdd.getNumPartitions() == 20  # 4 in the session: its tasks would grow with the claims
    assert sorted(r["slug"] for r in got.collect()) == sorted(f"part-{k}" for k in range(1000))
