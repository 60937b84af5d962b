"""Time layouts elected by file, refused rows set aside, and the linear forecaster's sums."""

import datetime
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from bedtide import config as C
from bedtide.operators import ridge
from bedtide.plans.engine import OccupancyEngine
from bedtide.sources import readers, staging, timeformats
from fixtures import visits_csv

DAY = datetime.datetime(2026, 1, 2)


def at(hour=0, minute=0, second=0.0, day=DAY):
    return day + datetime.timedelta(hours=hour, minutes=minute, seconds=second)


READ = {
    "2026-01-02T13:00:00Z": at(13), "2026-01-02 13:00": at(13), "2026-01-02": at(), "2026-01-02T13:00:00+02:00": at(11), "2026-01-02 13:00:00.250": at(13, 0, 0.25),
    "2026/01/02 13:00": at(13), "2026.1.2 1:05 pm": at(13, 5), "2026-01-02 1:00:00 PM": at(13), "01/02/2026 13:00": at(13), "1.2.26 5:07": at(5, 7), "1/2/71 12:00 AM": datetime.datetime(1971, 1, 2),
    "Jan 2, 2026 1:00 PM": at(13), "january 2nd 2026": at(), "2 January 2026, 12:05 am": at(0, 5), "2-Jan-2026 7:08:09 p.m.": at(19, 8, 9), "Fri, 2 Jan 2026 13:00": at(13),
    "20260102": at(), "20260102 1300": at(13), "20260102130509": at(13, 5, 9), "  01/02/2026 13:00 ": at(13),
}
UNREAD = ["99/99/2026", "n/a", "12:30", "2026-13-01", "2026-01-02 13:00 PM", "01/02/2026 25:00", "2026-01-02 0:10 am", "Foo 2, 2026", "01/02-2026", "x" * 5000]


def test_layouts(spark):
    texts = [*READ, *UNREAD, "", " ", None]
    got = timeformats.with_times(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), ["t"]).orderBy("i").collect()
    assert [r.t for r in got] == [*READ.values(), *[None] * (len(UNREAD) + 3)]
    assert [r.t_fault for r in got] == [None] * len(READ) + ["unreadable"] * len(UNREAD) + ["missing"] * 3


def test_files_elect_the_order_of_day_and_month(spark):
    rows = [("us", "01/02/2026"), ("us", "02/13/2026"), ("eu", "01/02/2026"), ("eu", "13/02/2026"), ("even", "01/02/2026"), ("mixed", "13/02/2026"), ("mixed", "14/02/2026"),
            ("mixed", "02/15/2026"), ("mixed", "2026-03-01"), (None, "13/02/2026"), ("none", "?")]
    frame = spark.createDataFrame(rows, "file string, t string")
    read = lambda strict: {(r.file, i): (str(r.t)[:10], r.t_fault) for i, r in enumerate(timeformats.with_times(frame.coalesce(1), ["t"], ["file"], strict).collect())}
    by_row = lambda found: sorted(((f or ""), *v) if v[1] is None else ((f or ""), "None", v[1]) for (f, _), v in found.items())
    loose = by_row(read(False))
    assert [r[1] for r in loose if r[0] == "us"] == ["2026-01-02", "2026-02-13"] and [r[1] for r in loose if r[0] == "eu"] == ["2026-02-01", "2026-02-13"]
    assert [r[1] for r in loose if r[0] == "even"] == ["2026-01-02"] and [r[1] for r in loose if r[0] == ""] == ["2026-02-13"]
    assert sorted(r[1:] for r in loose if r[0] == "mixed")[:3] == [("2026-02-13", None), ("2026-02-14", None), ("2026-03-01", None)]
    assert ("mixed", "None", "other layout") in loose and ("none", "None", "unreadable") in loose
    assert sum(r[2] == "other layout" for r in by_row(read(True)) if r[0] == "mixed") == 2
    table = {(r.file, r.layout): (r.parsed, r.chosen) for r in timeformats.vote_table(frame, ["t"], ["file"]).collect()}
    assert table["mixed", "day_first"] == (2, True) and table["mixed", "month_first"] == (1, False) and table["even", "month_first"] == (1, True)
    assert timeformats.with_times(frame.limit(0), ["t"], ["file"]).count() == 0


def test_refused_rows_are_kept_with_reason_and_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Visit ID,Admission Date Time,Discharge Time,Unit\n1,13/01/2026 10:00,14/01/2026,icu\n2,n/a,,icu\n3,,,"w\nx"\n4,01/14/2026 9:00,,ward\n5,15/01/2026 9:00,soon,ward\n')
    (tmp_path / "b.csv").write_text("Visit ID,Admission Date Time,Discharge Time,Unit\n6,01/14/2026 9:00 PM,,ward\n")
    raw = readers.read_raw(spark, str(tmp_path / "*.csv"), with_file=True).withColumnRenamed("Admission Date Time", "admission_time")
    counted = staging.write_staged(staging.staged(raw, "event"), str(tmp_path / "staged"))
    assert counted == {"rows": 6, "rejected": 3, "missing": 1, "other_layout": 1, "unreadable": 1, "discharge_missing": 1, "discharge_other_layout": 0, "discharge_unreadable": 1}
    kept = {r.patient_id: str(r.admission_time) for r in staging.accepted(spark, str(tmp_path / "staged")).collect()}
    assert kept == {"1": "2026-01-13 10:00:00", "5": "2026-01-15 09:00:00", "6": "2026-01-14 21:00:00"}
    gone = {json.loads(r.record)["Visit ID"]: (r.reason, r.file.rsplit("/", 1)[1]) for r in staging.quarantine(spark, str(tmp_path / "staged")).collect()}
    assert gone == {"2": ("admission_time: unreadable", "a.csv"), "3": ("admission_time: missing", "a.csv"), "4": ("admission_time: other layout", "a.csv")}
    typed = staging.staged(spark.createDataFrame([(None, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0)], "timestamp timestamp, admissions double, discharges double, " + ", ".join(f"{c} double" for c in C.OCCUPANCY_COLUMNS)), "aggregate")
    assert staging.write_staged(typed, str(tmp_path / "typed"))["missing"] == 1


def test_engine_keeps_refused_records(spark, tmp_path):
    path = visits_csv(tmp_path / "visits.csv")
    text = open(path).read()
    header, *lines = text.splitlines()
    column = header.split(",").index(next(h for h in header.split(",") if "dmi" in h))
    fields = lines[3].split(",")
    fields[column] = "some time"
    open(path, "w").write("\n".join([header, *lines, ",".join(fields)]) + "\n")
    engine = OccupancyEngine(spark, str(tmp_path / "root"), method="profile")
    assert engine.ingest(str(path), "spring visits").first().rejected_rows == 1
    refused = engine.rejected().collect()
    assert len(refused) == 1 and refused[0].reason.endswith(": unreadable") and "some time" in refused[0].record and refused[0].file.endswith("visits.csv")


def rows(seed, n=60):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, len(C.FEATURES))) * rng.uniform(0.5, 50, len(C.FEATURES)) + rng.normal(size=len(C.FEATURES)) * 20
    x[:, 3] = 1.0
    x[:, 7] = 2 * x[:, 6] - 1
    return x, x @ rng.normal(size=len(C.FEATURES)) + rng.normal(size=n)


def test_fit_from_sums_equals_fit_from_rows():
    upper = lambda z: np.array([z[:, i] @ z[:, j] for i, j in ridge.PAIRS])
    parts = [rows(s) for s in range(4)]
    tables = [np.column_stack(p) for p in parts]
    n, sums, products = np.array([60.0] * 4), np.stack([t.sum(axis=0) for t in tables]), np.stack([upper(t) for t in tables])
    weights, residual = ridge.solve(n, sums, products)
    assert residual.max() < 1e-6
    for (x, y), w, e in zip(parts, weights, ridge.squared_error(n, sums, products, weights)):
        scale = np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1)
        z = (x - x.mean(axis=0)) / scale
        v = np.linalg.solve(z.T @ z / len(z) + ridge.PENALTY * np.eye(z.shape[1]), z.T @ (y - y.mean()) / len(z))
        assert np.allclose(w[:-1], v / scale, atol=1e-8) and w[3] == 0
        assert e == pytest.approx(((y - x @ w[:-1] - w[-1]) ** 2).sum(), rel=1e-6)


def test_short_and_flat_series(spark):
    start = datetime.datetime(2026, 1, 1)
    frame = [("a", start + datetime.timedelta(hours=h), 1.0, 1.0, 0.0, 0.1, 10.0, 100.0 + h % 24, 3.0, 2.0, 115.0 + h % 24) for h in range(200)]
    frame += [("b", start + datetime.timedelta(hours=h), 0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0, 4.0) for h in range(74)]
    frame += [("c", start, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0, 4.0)]
    hours = spark.createDataFrame(frame, "facility_id string, ts timestamp, admissions double, discharges double, emergency_cases double, outbreak_signal double, "
                                  + ", ".join(f"{c} double" for c in C.OCCUPANCY_COLUMNS) + ", total_occupied double")
    from bedtide.operators.scenarios import baseline, facilities_of

    models = ridge.train(hours)
    table = {(r.facility_id, r.department): r for r in models.table.collect()}
    assert set(f for f, _ in table) == {"a", "b"} and all(r.residual < 1e-6 and r.rmse >= C.RMSE_FLOOR for r in table.values())
    points = ridge.ridge_forecast(hours, models, baseline(facilities_of(hours)), 24).collect()
    assert len(points) == 2 * 4 * 24
    ward = {p.step: p.occupied for p in points if p.facility_id == "a" and p.department == "ward"}
    assert all(abs(ward[s] - (100 + (199 + s) % 24)) < 2 for s in ward)
    assert all(p.occupied == 1.0 for p in points if p.facility_id == "b")
    assert ridge.train(hours.limit(0)).table.count() == 0


def test_engine_sets_stray_dates_aside(spark, tmp_path):
    path = visits_csv(tmp_path / "visits.csv")
    header, *lines = open(path).read().splitlines()
    names = header.split(",")
    column = names.index(next(h for h in names if "dmi" in h))
    fields = lines[3].split(",")
    fields[column] = "0202-01-01 05:00"
    open(path, "w").write("\n".join([header, *lines, ",".join(fields)]) + "\n")
    engine = OccupancyEngine(spark, str(tmp_path / "root"), method="profile")
    status = engine.ingest(str(path), "spring visits").first()
    assert status.rejected_rows == 0 and status.coverage_start > "2000" and status.rows < 10000
    assert [(r.rows, r.issue) for r in engine.issues().collect()] == [(1, "admission outside span")]
