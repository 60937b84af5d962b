import numpy as np
import pytest
from pyspark.sql import functions as F

from bedtide import config as C
from bedtide.operators import features, hourly, scenarios
from bedtide.operators.capacity import capacities
from bedtide.operators.recursive import gbt_forecast, predict, tree_arrays
from bedtide.operators.scenarios import Scenario
from bedtide.operators.training import model_metrics, scaled_frame, train_all, validation_errors
from bedtide.session import materialise
from fixtures import HOURS, visits


@pytest.fixture(scope="module")
def fact(spark):
    return materialise(hourly.hourly_from_encounters(visits(spark, "a").unionByName(visits(spark, "b"))))


@pytest.fixture(scope="module")
def models(fact):
    return train_all(fact, "2026-02-01 00:00:00", maxIter=3, maxDepth=4)


def test_metrics(fact, models):
    rows = model_metrics(models).collect()
    assert len(rows) == 8
    assert all(r.rmse >= 1.5 for r in rows)
    ranges = models.metrics.select("min_observed", "max_observed", "rows").collect()
    assert all(r.min_observed <= r.max_observed and r.rows == HOURS - 72 for r in ranges)


def test_saved_trees_predict_as_the_model(spark, fact, models):
    arrays = tree_arrays(spark, models)
    constant = models.metrics.select("facility_id", "department", *C.SERIES_FEATURES)
    rows = scaled_frame(features.training_frame(fact).join(capacities(fact), ["facility_id", "department"]).join(constant, ["facility_id", "department"]))
    for department in C.DEPARTMENTS:
        scored = models.model(department).transform(rows.where(F.col("department") == department)).select("features", "prediction").toPandas()
        x = np.stack([v.toArray() for v in scored.features])
        assert predict(arrays[department], x) == pytest.approx(scored.prediction.to_numpy(), abs=1e-9)


def slow_forecast(fact, trees, department, scenario, horizon, capacity, constant):
    """One hour at a time with a growing history, as a plain loop."""
    series = fact.where("facility_id = 'a'").orderBy("ts").toPandas()
    known = scenarios.future_frame(fact, scenario, horizon).where("facility_id = 'a'").orderBy("step").toPandas()
    history = series[f"{department}_occupied"].tolist()
    out = []
    for _, row in known.iterrows():
        x = {c: float(row[c]) for c in C.CALENDAR_FEATURES + C.EXOGENOUS + C.EXOGENOUS_ROLLING_FEATURES}
        x |= {f"lag_{k}": history[-k] / capacity for k in C.TARGET_LAGS}
        x |= {f"rolling_mean_{w}": np.mean(history[-w:]) / capacity for w in C.TARGET_WINDOWS}
        value = predict(trees, np.array([[x[c] for c in C.FEATURES] + constant]))[0] * capacity
        if row.active:
            value += row.occupancy_delta
        history.append(min(capacity, max(0.0, value)))
        out.append(history[-1])
    return out


@pytest.mark.parametrize("scenario", [None, Scenario("surge", "", 1.2, 0.9, 1.5, 0.2, 4.0, 6)])
def test_recursion_against_a_plain_loop(spark, fact, models, scenario):
    everyone = scenarios.facilities_of(fact)
    chosen = scenarios.baseline(everyone) if scenario is None else scenarios.scenarios_for(everyone, [scenario])
    cut = hourly.up_to_last_admission(fact)
    points = gbt_forecast(cut, models, chosen, 12).where("facility_id = 'a'").toPandas()
    trees = tree_arrays(spark, models)
    for department, capacity in zip(C.DEPARTMENTS, [50, 260, 75, 45]):
        got = points[points.department == department].sort_values("step").occupied.to_numpy()
        own = models.metrics.where(f"facility_id = 'a' AND department = '{department}'").first()
        assert own.capacity_beds == capacity and 0 < own.usual_share < 1 and own.share_deviation > 0
        want = slow_forecast(cut, trees[department], department, chosen, 12, capacity, [own[c] for c in C.SERIES_FEATURES])
        assert got == pytest.approx(np.round(want, 1), abs=0.051)


def test_points_stay_within_bounds_and_horizons_mix(fact, models):
    everyone = scenarios.facilities_of(fact)
    chosen = scenarios.baseline(everyone).unionByName(
        scenarios.scenarios_for(everyone, [Scenario("up", occupancy_delta=100.0, duration_hours=9), Scenario("down", occupancy_delta=-100.0, duration_hours=30)])
    )
    points = gbt_forecast(fact, models, chosen, None).toPandas()
    assert points.groupby("scenario_id").step.max().to_dict() == {0: 6, 1: 9, 2: 30}
    assert len(points) == 2 * 4 * (6 + 9 + 30)
    assert ((0 <= points.lower) & (points.lower <= points.occupied) & (points.occupied <= points.upper) & (points.upper <= points.capacity)).all()
    start = points[(points.scenario_id == 1) & (points.step == 1)]
    assert (start.occupied >= start.capacity.clip(upper=100)).all()


def test_history_shorter_than_memory(fact, models):
    short = fact.where("ts < '2025-05-02 00:00:00'")
    points = gbt_forecast(short, models, scenarios.baseline(scenarios.facilities_of(short)), 6)
    assert points.where("occupied IS NULL OR isnan(occupied)").isEmpty() and points.count() == 48


def test_training_needs_rows(fact):
    with pytest.raises(ValueError, match="Insufficient training rows"):
        train_all(fact.where("ts < '2025-05-02 00:00:00'"), maxIter=1)


def test_error_without_validation_rows(spark):
    rows = [("a", "icu", 1.0, 1.0, 10, 10.0, True), ("a", "icu", 1.0, 1.0, 10, 110.0, True)]
    df = spark.createDataFrame(rows, "facility_id string, department string, label double, prediction double, capacity int, target double, is_train boolean")
    assert validation_errors(df).first().rmse == pytest.approx(np.std([10, 110], ddof=1) * 0.15)


def test_unknown_values_follow_the_fuller_child():
    tree = {"feature": np.array([[0, -1, -1]]), "left": np.array([[1, -1, -1]]), "right": np.array([[2, -1, -1]]), "threshold": np.array([[5.0, 0, 0]]),
            "value": np.array([[0.0, 10.0, 20.0]]), "weight": np.array([1.0])}
    for rows, unknown in (([9, 6, 3], 10.0), ([9, 2, 7], 20.0)):
        got = predict(tree | {"rows": np.array([rows])}, np.array([[4.0], [6.0], [np.nan]]))
        assert got.tolist() == [10.0, 20.0, unknown]
