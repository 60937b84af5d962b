import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bedtide import config as C
from bedtide.operators import alerts, features, forecast, hourly, profile, scenarios
from bedtide.operators.scenarios import Scenario
from bedtide.session import materialise
from fixtures import HOURS, visits

HEAT = Scenario("Heat wave", "Hot days", 1.3, 0.9, 1.4, 0.15, 6.0, 60)


@pytest.fixture(scope="module")
def fact(spark):
    return materialise(hourly.hourly_from_encounters(visits(spark, "a").unionByName(visits(spark, "b"))))


@pytest.fixture(scope="module")
def series(fact):
    return fact.where("facility_id = 'a'").orderBy("ts").toPandas()


def test_training_frame_against_pandas(fact, series):
    got = features.training_frame(fact).where("facility_id = 'a' AND department = 'ward'").orderBy("ts").toPandas()
    t = series["ward_occupied"]
    want = pd.DataFrame({"ts": series.ts})
    for k in C.TARGET_LAGS:
        want[f"lag_{k}"] = t.shift(k)
    for w in C.TARGET_WINDOWS:
        want[f"rolling_mean_{w}"] = t.shift(1).rolling(w).mean()
    for name, c in zip(C.EXOGENOUS_ROLLING_FEATURES, C.EXOGENOUS):
        want[name] = series[c].shift(1).rolling(24).mean()
    want = want.dropna()
    assert len(got) == len(want) == len(series) - 72
    for c in want.columns[1:]:
        assert got[c].to_numpy() == pytest.approx(want[c].to_numpy(), abs=1e-9)
    hour, dow = got.ts.dt.hour, got.ts.dt.dayofweek
    assert (got.day_of_week == dow).all() and (got.is_weekend == (dow >= 5)).all()
    assert got.hour_sin.to_numpy() == pytest.approx(np.sin(2 * math.pi * hour / 24).to_numpy(), abs=1e-12)
    assert got.dow_cos.to_numpy() == pytest.approx(np.cos(2 * math.pi * dow / 7).to_numpy(), abs=1e-12)


def test_unknown_value_drops_the_row_for_every_department(fact):
    holed = fact.withColumn("icu_occupied", F.when(F.col("ts") != F.lit("2025-05-10 00:00:00").cast("timestamp"), F.col("icu_occupied")))
    counts = {r[0]: r[1] for r in features.training_frame(holed.where("facility_id = 'a'")).groupBy("department").count().collect()}
    assert counts["ward"] == HOURS - 72 - 1
    # The hole is also inside the 72-hour window of the 72 rows after it.
    assert counts["icu"] == HOURS - 72 - 1 - 72


def test_time_split(fact):
    split = features.time_split(features.training_frame(fact)).where("facility_id = 'b' AND department = 'icu'").orderBy("ts").toPandas()
    assert split.is_train.tolist() == [i < int((HOURS - 72) * 0.85) for i in range(HOURS - 72)]
    one = features.time_split(features.training_frame(fact).where("ts = '2025-05-15 00:00:00'"))
    assert one.where("NOT is_train").isEmpty()


def test_profile_and_fallback(fact, series):
    got = profile.exogenous_profile(fact).where("facility_id = 'a'").toPandas().set_index(["dow", "hour"])
    want = series.groupby([series.ts.dt.dayofweek, series.ts.dt.hour])[C.EXOGENOUS].mean()
    for c in C.EXOGENOUS:
        assert got[c].sort_index().to_numpy() == pytest.approx(want[c].sort_index().to_numpy(), abs=1e-12)
    short = fact.where("facility_id = 'a' AND ts < '2025-05-03 05:00:00'")
    dense = profile.dense_profile(short).toPandas().set_index(["dow", "hour"])
    assert len(dense) == 168 and dense.profile_fallback.sum() == 168 - 53
    part = series[series.ts < "2025-05-03 05:00:00"]
    assert dense.loc[(0, 7), "admissions"] == part[part.ts.dt.hour == 7].admissions.mean()
    tiny = profile.dense_profile(fact.where("facility_id = 'a' AND ts < '2025-05-01 03:00:00'")).toPandas().set_index(["dow", "hour"])
    assert tiny.loc[(0, 7), "admissions"] == pytest.approx(part[part.ts < "2025-05-01 03:00:00"].admissions.mean())


def brute_future(series, horizon, scenario=None):
    """Row by row: project, adjust, append, average."""
    means = series.groupby([series.ts.dt.dayofweek, series.ts.dt.hour])[C.EXOGENOUS].mean()
    past = {c: series[c].astype(float).tolist() for c in C.EXOGENOUS}
    rows = []
    for step in range(1, horizon + 1):
        ts = series.ts.iloc[-1] + pd.Timedelta(hours=step)
        values = dict(means.loc[(ts.dayofweek, ts.hour)])
        if scenario and step <= scenario.duration_hours:
            values["admissions"] *= scenario.admissions_multiplier
            values["discharges"] *= scenario.discharges_multiplier
            values["emergency_cases"] *= scenario.emergency_multiplier
            values["outbreak_signal"] = min(1.0, max(0.0, values["outbreak_signal"] + scenario.outbreak_delta))
        rolled = {n: np.mean(past[c][-24:]) for n, c in zip(C.EXOGENOUS_ROLLING_FEATURES, C.EXOGENOUS)}
        rows.append({"ts": ts, **values, **rolled})
        for c in C.EXOGENOUS:
            past[c].append(values[c])
    return pd.DataFrame(rows)


@pytest.mark.parametrize("scenario", [None, HEAT])
def test_future_frame_step_by_step(fact, series, scenario):
    facilities = scenarios.facilities_of(fact)
    chosen = scenarios.baseline(facilities) if scenario is None else scenarios.scenarios_for(facilities, [scenario])
    got = scenarios.future_frame(fact, chosen, 96).where("facility_id = 'a'").orderBy("step").toPandas()
    want = brute_future(series, 96, scenario)
    assert len(got) == 96 and (got.ts.to_numpy() == want.ts.to_numpy()).all()
    for c in C.EXOGENOUS + C.EXOGENOUS_ROLLING_FEATURES:
        assert got[c].to_numpy() == pytest.approx(want[c].to_numpy(), abs=1e-9)


def test_scenario_ends_with_its_duration(fact):
    chosen = scenarios.scenarios_for(scenarios.facilities_of(fact), [HEAT])
    points = forecast.profile_forecast(fact, chosen, 96).where("facility_id = 'a' AND department = 'ward'").orderBy("step").toPandas()
    plain = forecast.profile_forecast(fact, scenarios.baseline(scenarios.facilities_of(fact)), 96).where("facility_id = 'a' AND department = 'ward'").orderBy("step").toPandas()
    difference = points.occupied - plain.occupied
    assert difference[:60].to_numpy() == pytest.approx(np.full(60, 6.0), abs=0.11)
    assert (difference[60:] == 0).all()
    own = forecast.profile_forecast(fact, chosen, None)
    assert own.groupBy("facility_id", "department").count().select("count").distinct().collect() == [(60,)]


def test_band_and_summary(fact):
    everyone = scenarios.facilities_of(fact)
    wild = [Scenario("up", occupancy_delta=100.0), Scenario("down", occupancy_delta=-100.0), HEAT]
    points = forecast.profile_forecast(fact, scenarios.scenarios_for(everyone, wild), 48).toPandas()
    assert len(points) == 2 * 4 * 3 * 48
    assert (points.lower <= points.occupied).all() and (points.occupied <= points.upper).all()
    assert (points.lower >= 0).all() and (points.upper <= points.capacity).all()
    summary = forecast.forecast_summary(forecast.profile_forecast(fact, scenarios.scenarios_for(everyone, wild), 48)).toPandas()
    assert len(summary) == 24 and (summary.horizon_hours == 48).all()
    for _, row in summary.iterrows():
        own = points[(points.facility_id == row.facility_id) & (points.scenario_id == row.scenario_id) & (points.department == row.department)].sort_values("step")
        first = own.iloc[own.occupied.to_numpy().argmax()]
        assert (row.peak_occupancy, row.peak_timestamp) == (first.occupied, first.timestamp)
        assert (row.crossing_timestamp is not None) == (first.utilization >= 0.9)
    nested = forecast.nested_forecasts(forecast.profile_forecast(fact, scenarios.baseline(everyone), 6)).first()
    assert [p.step for p in nested.points] == [1, 2, 3, 4, 5, 6]


def points_of(spark, rows):
    return spark.createDataFrame(rows, "facility_id string, scenario_id bigint, department string, step int, timestamp string, utilization double")


def test_alert_rules(spark):
    rows = [
        ("a", 0, "icu", 1, "t1", 0.899), ("a", 0, "icu", 2, "t2", 0.9), ("a", 0, "icu", 3, "t3", 0.99),
        ("a", 0, "ward", 1, "t1", 0.97), ("a", 0, "emergency", 1, "t1", 0.97), ("a", 0, "pediatric", 1, "t1", 0.5),
    ]
    got = alerts.compute_alerts(points_of(spark, rows)).orderBy("position").collect()
    assert [(r.department, r.timestamp, r.severity) for r in got] == [
        ("ward", "t1", "critical"), ("emergency", "t1", "critical"), ("icu", "t2", "warning")]
    assert got[2].message == "ICU occupancy is forecast to reach 90% against a 90% threshold."
    stored = spark.createDataFrame([("a", "icu", 0.95), ("a", "pediatric", 0.5)], "facility_id string, department string, utilization_threshold double")
    got = alerts.compute_alerts(points_of(spark, rows), stored).orderBy("position").collect()
    assert [(r.department, r.timestamp, r.threshold) for r in got] == [
        ("icu", "t3", 0.95), ("ward", "t1", 0.9), ("emergency", "t1", 0.9), ("pediatric", "t1", 0.5)]
    assert alerts.compute_alerts(points_of(spark, rows), stored, 0.98).count() == 1


def test_many_scenarios_in_one_plan(fact):
    many = [Scenario(f"s{i:02d}", occupancy_delta=float(i)) for i in range(20)]
    chosen = scenarios.scenarios_for(scenarios.facilities_of(fact), many)
    assert forecast.profile_forecast(fact, chosen, 6).count() == 2 * 4 * 20 * 6
