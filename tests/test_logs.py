"""The log formats, on files made here."""

import pytest

from tessera.sources import logs

NATIVE = """OBD Data Log
Start Time: 2025-07-23 14:42:16
Log Interval: 1
----
Timestamp\tRPM\tSPEED\tGET_DTC\tGET_CURRENT_DTC
----
2025-07-23 14:42:16\t800\tN/A\t[('P0301', 'Misfire')]\t[('P0301', ''), ('U0100', '')]
2025-07-23 14:42:17\t810.5\t3\t[]\t[]
2025-07-23 14:42:18\t820
\x00\x00\t1\t2\t[]\t[]
Log ended
"""
OBDWIZ = """Time,车速 (MPH),发动机转速 (RPM),发动机冷却液温度 (°F),别的
03/18/2026 12:46:45.2597 上午,10,745,212,1
03/18/2026 12:46:46.2597 上午,10,745,212,2
03/18/2026 01:46:47.2597 下午,20,N/A,32,3
"""
MAXLOG = """# VIN: X
# vehicle_id: V-1234
Timestamp,RPM (rpm),"LOAD, A (%)",DTC_COUNT,SPEED
2026-01-01T00:00:00.123,900,"1,5",2,7
,,,,
"""
DUAL = """﻿# Yamaha Dual OBDLink EX Log
Timestamp,A_KL_RPM,A_YAM_X,A_KL_IAT
2026-01-01 00:00:00.5,1200,9,
"""
GENERIC = "Timestamp,RPM,SPEED\n2026-01-01 00:00:00,1000,5\nbad,1,2\n"


@pytest.fixture(scope="module")
def files(spark):
    bodies = {"native": NATIVE, "wiz": OBDWIZ, "max": MAXLOG, "dual": DUAL, "generic": GENERIC, "empty": "", "none": None}
    return spark.createDataFrame(list(bodies.items()), "session_id string, body string")


def cells(df, session):
    return [(r["row_id"], str(r["ts"]), r["signal"], r["raw"], r["value"]) for r in df.where(df.session_id == session).orderBy("row_id", "signal").collect()]


def test_formats(files):
    got = {r["session_id"]: r["format"] for r in logs.sniff(files).collect()}
    assert got == {"native": "native_tsv", "wiz": "csvlog_obdwiz", "max": "obd_maxlog", "dual": "yamaha_dual", "generic": "generic_csv", "empty": "native_tsv", "none": "native_tsv"}


def test_rows(spark, files):
    long = logs.rows(files)
    native = [c for c in cells(long, "native") if c[2] in ("RPM", "SPEED")]
    assert [(c[0], c[2], c[4]) for c in native] == [(0, "RPM", 800), (0, "SPEED", None), (1, "RPM", 810.5), (1, "SPEED", 3)]
    wiz = cells(long, "wiz")
    assert [c[0] for c in wiz] == [0, 0, 0, 2, 2, 2]  # the second row repeats the first
    assert wiz[0][2:] == ("COOLANT_TEMP", "100.00", 100) and wiz[2][2:] == ("SPEED", "16.09", 16.09) and wiz[4][3] == "N/A"
    hours = [r[0] for r in spark.createDataFrame(long.where("session_id = 'wiz' AND signal = 'RPM'").collect(), long.schema).selectExpr("hour(ts)").collect()]
    assert sorted(hours) == [0, 13]
    assert [c[2:4] for c in cells(long, "max")] == [("LOAD, A", "1,5"), ("RPM", "900"), ("SPEED", "7")]
    assert [c[2:] for c in cells(long, "dual")] == [("INTAKE_TEMP", "", None), ("RPM", "1200", 1200)]
    assert len(cells(logs.rows(files, all_channels=True), "dual")) == 3
    assert [c[2:] for c in cells(long, "generic")] == [("RPM", "1000", 1000), ("SPEED", "5", 5)]
    assert not cells(long, "empty") and not cells(long, "none")


def test_codes_and_vehicle(files):
    got = sorted(map(tuple, logs.trouble_codes(logs.rows(files)).collect()))
    assert got == [("native", "P0301", "stored", 0), ("native", "U0100", "pending", 0)]
    ids = {r["session_id"]: r["vehicle_id"] for r in logs.vehicle(files).collect()}
    assert ids["max"] == "V-1234" and ids["native"] is None


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "a.csv").write_text(GENERIC)
    assert logs.rows(logs.read_files(spark, str(tmp_path))).select("session_id").distinct().collect()[0][0] == "a"
