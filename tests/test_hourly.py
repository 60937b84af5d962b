import random
import statistics
from collections import Counter
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from bedtide import config as C
from bedtide.operators import capacity, hourly, kpis, quality, signal, stays, trends
from bedtide.sources import adapters
from bedtide.sources.readers import canonical_encounters
from fixtures import HOURS, counted, readings, visit_rows, visits


def frame(df):
    return df.orderBy("facility_id", "ts").toPandas()


def test_few_visits(spark):
    fact = hourly.hourly_from_encounters(visits(spark, n=9))
    f, want = frame(fact), list(counted(visit_rows(9)))
    assert [t.to_pydatetime() for t in f.ts] == [w[0] for w in want]
    assert f[hourly.FLOWS].to_numpy().tolist() == [list(w[1:4]) for w in want]
    assert f[C.OCCUPANCY_COLUMNS].to_numpy().tolist() == [w[4] for w in want]
    assert f.total_occupied.tolist() == [sum(w[4]) for w in want]
    with pytest.raises(ValueError):
        quality.require_min_rows(fact)
    assert quality.short_series(fact).first().rows == len(want)


def test_many_visits(spark):
    rows, want = list(visit_rows()), list(counted(visit_rows()))
    fact = hourly.hourly_from_encounters(visits(spark)).cache()
    f = frame(fact)
    median = statistics.median((b - a).total_seconds() / 3600 for a, b, *_ in rows)
    assert stays.default_stays(visits(spark)).first().default_stay_hours == pytest.approx(median, abs=1e-9)
    assert len(f) == HOURS and f[hourly.FLOWS].to_numpy().tolist() == [list(w[1:4]) for w in want]
    assert f[C.OCCUPANCY_COLUMNS].to_numpy().tolist() == [w[4] for w in want]
    assert f.outbreak_signal.between(0, 1).all() and f.outbreak_signal.max() > 0.5
    analytics = kpis.overview_analytics(fact).first()
    by_hour = Counter({h: 0 for h in range(24)}) + Counter()
    for hour, admitted, *_ in want:
        by_hour[hour.hour] += admitted
    per_hour = {h: n / sum(w[0].hour == h for w in want) for h, n in by_hour.items()}
    assert per_hour[int(analytics.peak_admission_hour[:2])] == pytest.approx(max(per_hour.values()))
    departments = {r.department: r for r in kpis.overview_departments(fact).collect()}
    assert [departments[d].occupied for d in C.DEPARTMENTS] == want[-1][4]
    assert [departments[d].delta_24h for d in C.DEPARTMENTS] == [x - y for x, y in zip(want[-1][4], want[-25][4])]
    assert kpis.overview_hospital(fact).first().total_capacity == sum(r.capacity for r in capacity.capacities(fact).collect())
    assert trends.occupancy_history(fact).count() == 168
    assert trends.downsample(trends.occupancy_history(fact)).count() == 56
    assert trends.occupancy_history(fact, 5).count() == 24
    assert trends.daily_flow(fact).count() == min(21, len({w[0].date() for w in want}))
    meta = capacity.dataset_metadata(fact, "x", "event_level_his").first()
    assert (meta.rows, meta.coverage_start, meta.coverage_end) == (HOURS, want[0][0].isoformat(), want[-1][0].isoformat())
    quality.require_min_rows(fact)


def test_as_of_gives_a_populated_latest_row(spark):
    fact = hourly.hourly_from_encounters(visits(spark))
    cut = hourly.up_to_last_admission(fact)
    latest = {r.department: r.occupied for r in kpis.overview_departments(cut).collect()}
    assert sum(latest.values()) > 0
    assert hourly.up_to(fact, "2025-05-02 00:00:00").count() == 25


@pytest.mark.parametrize("unit", ["microseconds", "seconds", "minutes", "hours"])
def test_median_is_exact(spark, unit):
    rng = random.Random(7)
    rows, groups = [], {}
    for facility, n in [("a", 1), ("b", 2), ("c", 101), ("d", 400), ("e", 3)]:
        for _ in range(n):
            length = timedelta(**{unit: rng.randint(-50, 400) if facility != "e" else 0})
            start = datetime(2026, 1, 1) + timedelta(seconds=rng.randint(0, 10**6))
            rows.append((facility, start, start + length))
            groups.setdefault(facility, []).append(length / timedelta(microseconds=1))
    df = canonical_encounters(spark.createDataFrame(rows, ["facility_id", "admission_time", "discharge_time"]))
    got = {r.facility_id: r for r in stays.median_stays(stays.stay_lengths(df)).collect()}
    for facility, lengths in groups.items():
        assert got[facility].median_micros == pd.Series(lengths).median()
        assert got[facility].any_nonzero == any(lengths)
    hours = {r.facility_id: r.default_stay_hours for r in stays.default_stays(df).collect()}
    assert hours["e"] == 36.0
    assert min(hours.values()) >= 12.0


def test_imputation_and_buckets(spark):
    rows = [
        ("2026-01-01 10:00:00", "2026-01-01 10:00:00"),   # no stay: imputed
        ("2026-01-01 10:59:59", "2026-01-01 11:00:00"),   # ends on the hour
        ("2026-01-01 10:10:00", "2026-01-01 10:20:00"),   # within one hour: one bucket
        ("2026-01-01 10:10:00", None),
        ("2026-01-01 10:10:00", "2026-01-01 12:00:00.000001"),
    ]
    df = canonical_encounters(spark.createDataFrame(rows, ["admission_time", "discharge_time"]))
    clean = stays.clean_encounters(df).toPandas()
    assert clean.discharge_imputed.sum() == 2
    ends = sorted(str(t) for t in clean.discharge_bucket)
    assert ends == ["2026-01-01 11:00:00", "2026-01-01 11:00:00", "2026-01-01 13:00:00", "2026-01-01 22:00:00", "2026-01-01 23:00:00"]


def test_facility_without_any_discharge(spark):
    df = canonical_encounters(spark.createDataFrame([("x", "2026-01-01 00:00:00")], ["facility_id", "admission_time"]))
    assert str(stays.clean_encounters(df).first().discharge_bucket) == "2026-01-02 12:00:00"


def test_overlap_equals_running_sum(spark, small_dir):
    clean = stays.clean_encounters(adapters.encounters_from_events(spark, small_dir))
    running = hourly.by_department(hourly.hourly_occupancy(clean)).where("occupied > 0")
    overlap = hourly.occupancy_by_overlap(clean).select(running.columns)
    assert running.exceptAll(overlap).isEmpty() and overlap.exceptAll(running).isEmpty()
    assert running.count() > 1000


def test_flow_invariants_and_partition_independence(spark, small_dir):
    encounters = adapters.encounters_from_events(spark, small_dir)
    first = hourly.hourly_from_encounters(encounters)
    sums = first.agg(F.sum("admissions"), F.sum("discharges")).first()
    assert sums[0] == sums[1] == encounters.count()
    second = hourly.hourly_from_encounters(encounters.repartition(13))
    assert first.exceptAll(second).isEmpty()


def test_wide_and_long_agree(spark):
    fact = hourly.hourly_occupancy(stays.clean_encounters(visits(spark, n=9)))
    wide = hourly.by_column(hourly.by_department(fact))
    assert wide.exceptAll(fact.select(wide.columns)).isEmpty()


def test_reading_gaps(spark):
    df = readings(spark, [("2026-01-01 00:10", 1, 1, 5, 0, 0, 0), ("2026-01-01 03:10", 2, 2, 6, 0, 0, 0)])
    rows = hourly.hourly_from_readings(df).orderBy("ts").collect()
    assert [r.admissions for r in rows] == [1, 0, 0, 2]
    assert [r.icu_occupied for r in rows] == [5, None, None, 6]
    assert [r.total_occupied for r in rows] == [5, 0, 0, 6]
    assert rows[0].outbreak_signal == 0


def test_reading_rows_pass_unchanged(spark):
    columns = ["date", "admit_count", "released", "er_cases", "icu_occupancy", "ward_occupied", "emergency_occupied", "pediatric_occupied", "surge_signal"]
    rows = [(f"2026-01-12T{8 + i:02d}:00:00", 14 + i, 8 + i, 5 + i, 18 + i, 124 + i, 12, 9, 0.06 + i / 100) for i in range(10)]
    out = hourly.hourly_from_readings(readings(spark, rows, columns)).orderBy("ts").collect()
    for row, r in zip(rows, out):
        assert [r.admissions, r.discharges, r.emergency_cases, r.icu_occupied, r.ward_occupied, r.outbreak_signal] == [*row[1:6], row[8]]


def test_absent_signal_is_zero_or_derived(spark):
    rows = [(f"2026-01-{1 + i // 24:02d} {i % 24:02d}:00", (i * 7) % 5, 1, 5, 5, 5, 5) for i in range(72)]
    plain = hourly.hourly_from_readings(readings(spark, rows))
    derived = hourly.hourly_from_readings(readings(spark, rows), "when_absent")
    assert plain.agg(F.max("outbreak_signal")).first()[0] == 0
    assert derived.agg(F.max("outbreak_signal")).first()[0] > 0


def brute_signal(adm, em):
    def excess(x):
        base = x.rolling(168, min_periods=24).mean().fillna(x.expanding().mean())
        spread = x.rolling(168, min_periods=24).std()
        spread = spread.where(spread > 1e-9)
        overall = x.std()
        return ((x - base) / spread.fillna(overall if overall else 1.0)).clip(lower=0)
    combined = 0.7 * excess(adm) + 0.3 * excess(em)
    return (combined / max(combined.max(), 1.0)).fillna(0).clip(0, 1)


@pytest.mark.parametrize("n, constant", [(500, False), (30, False), (10, False), (1, False), (200, True)])
def test_signal_against_pandas(spark, n, constant):
    rng = random.Random(n)
    hours = pd.date_range("2026-01-01", periods=n, freq="h")
    f = pd.DataFrame({"facility_id": "a", "ts": hours,
                      "admissions": [3 if constant else rng.randint(0, 9) for _ in hours],
                      "emergency_cases": [0 if constant else rng.randint(0, 4) for _ in hours]})
    got = signal.with_outbreak_signal(spark.createDataFrame(f)).orderBy("ts").toPandas().outbreak_signal
    want = brute_signal(f.admissions.astype(float), f.emergency_cases.astype(float))
    assert got.tolist() == pytest.approx(want.tolist(), abs=1e-9)


def test_hot_facility_does_not_change_results(spark):
    hot = visits(spark, "hot")
    for _ in range(3):
        hot = hot.unionByName(hot)
    both = hot.unionByName(visits(spark, "cold"))
    f = frame(hourly.hourly_from_encounters(both))
    cold, warm = f[f.facility_id == "cold"], f[f.facility_id == "hot"]
    assert (warm.icu_occupied.to_numpy() == 8 * cold.icu_occupied.to_numpy()).all()
    assert len(cold) == len(warm) == HOURS


def test_a_shared_folder_must_be_named_off_local_masters():
    from bedtide.session import shared_folder

    class Nothing:
        master, get = "spark://head:7077", staticmethod(lambda *a: None)
        getConf = lambda self: self

    class Session:
        conf, sparkContext = Nothing(), Nothing()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())
