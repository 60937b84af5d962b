import pytest
from pyspark.sql import functions as F

from bedtide import config as C
from bedtide.plans.engine import OccupancyEngine
from bedtide.plans.queries import REGISTERED
from fixtures import HOURS, counted, visit_rows, visits_csv
from test_state import PAYLOAD, payload


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("engine")
    built = OccupancyEngine(spark, str(folder / "root"), learner={"maxIter": 2, "maxDepth": 3})
    with pytest.raises(ValueError, match="No dataset"):
        built.forecast()
    status = built.ingest(visits_csv(folder / "visits.csv"), "spring visits").first()
    assert status.source_name == "spring visits" and status.source_type == "event_level_his" and status.rows == HOURS
    assert all(status.model_metrics[d].rmse >= C.RMSE_FLOOR for d in C.DEPARTMENTS)
    return built


def test_dashboard(engine):
    screen = engine.dashboard(30)
    assert screen["forecasts"].groupBy("department").count().where("count <> 30").isEmpty()
    assert sorted(r.department for r in screen["overview"]["departments"].collect()) == sorted(C.DEPARTMENTS)
    assert screen["trends"]["daily_flow"].count() == len({w[0].date() for w in counted(visit_rows())})
    assert screen["thresholds"].count() == screen["summaries"].count() == len(C.DEPARTMENTS)
    assert screen["dataset"].first().rows == HOURS and "alerts" in screen


def test_thresholds(engine):
    values = {"pediatric": 0.55, "icu": 0.66, "emergency": 0.77, "ward": 0.99}
    assert {r.department: r.utilization_threshold for r in engine.update_thresholds(values).collect()} == values
    for wrong in ({"ward": 0.3}, {"icu": 0.7, "ward": 1.2}, {"attic": 0.8}):
        with pytest.raises(ValueError):
            engine.update_thresholds(wrong)
    assert {r.department: r.utilization_threshold for r in engine.thresholds().collect()} == values
    bulk = engine.spark.createDataFrame(
        [(7, "f0", "icu", 0.51, "eve", "2025-06-01"), (7, "f0", "attic", 0.51, "eve", "2025-06-01"),
         (8, "f0", "emergency", 0.62, "eve", "2025-06-02"), (9, "f0", "emergency", 0.73, "eve", "2025-06-03")],
        "request_id int, facility_id string, department string, utilization_threshold double, updated_by string, updated_at string")
    assert engine.apply_threshold_updates(bulk).count() == 1
    assert {r.department: r.utilization_threshold for r in engine.thresholds().collect()} == values | {"emergency": 0.73}


def test_scenarios(engine, spark):
    make = lambda *rows: spark.createDataFrame(list(rows), PAYLOAD)
    keys = lambda *ids: spark.createDataFrame([("f0", i) for i in ids], "facility_id string, id bigint")
    festival = payload("f0", name="City festival", admissions_multiplier=1.4, emergency_multiplier=2.0, occupancy_delta=3.0, duration_hours=40)
    crash = payload("f0", name="Train crash", occupancy_delta=90.0, duration_hours=8)
    assert [r.id for r in engine.save_scenarios(make(festival)).collect()] == [1]
    assert {r.name: r.id for r in engine.save_scenarios(make(crash)).collect()} == {"City festival": 1, "Train crash": 2}
    for wrong, why in ((payload("f0", name="?"), "Invalid scenario"), (payload("f0", 41, "nobody"), "could not be saved")):
        with pytest.raises(ValueError, match=why):
            engine.save_scenarios(make(wrong))
    with pytest.raises(ValueError, match="more than once"):
        engine.save_scenarios(make(payload("f0", 1, "one way"), payload("f0", 1, "or another")))
    one = engine.simulate(keys(1), 36)
    assert one["forecasts"].count() == 36 * len(C.DEPARTMENTS) and one["summary"].count() == len(C.DEPARTMENTS)
    before = engine.alert_history().count()
    both = engine.simulate(keys(1, 2))
    lengths = both["forecasts"].groupBy("scenario_id").agg((F.count("*") / len(C.DEPARTMENTS)).alias("n")).collect()
    assert {r.scenario_id: r.n for r in lengths} == {1: 40, 2: 8}
    assert both["alerts"].where("scenario_id = 2").count() >= 2
    assert engine.alert_history().count() == before
    stored = engine.scenario("f0", 2).first()
    assert stored.last_run_at is not None and {s.department for s in stored.last_run_summary.summary} == set(C.DEPARTMENTS)
    engine.delete_scenarios(keys(2))
    assert {r.id for r in engine.save_scenarios(make(crash)).collect()} == {1, 3}
    with pytest.raises(ValueError, match="not found"):
        engine.simulate(keys(55))


def test_alerts_are_merged(engine):
    early = engine.forecast(6, "icu", as_of="2025-05-15 00:00:00").orderBy("step").collect()
    assert early[0].timestamp == "2025-05-15T01:00:00" and len(early) == 6
    first = engine.alerts(24, 0.5)
    history = engine.alert_history(200).count()
    engine.alerts(24, 0.5)
    assert engine.alert_history(200).count() == history >= first.count()
    with pytest.raises(ValueError):
        engine.alerts(24, 0.4)
    with pytest.raises(ValueError):
        engine.forecast(200)
    with pytest.raises(ValueError, match="Unknown department"):
        engine.forecast(24, "burns")


def test_short_dataset_is_refused_and_the_old_one_stays(engine, spark, tmp_path):
    path = tmp_path / "short.csv"
    path.write_text("admission_time,department\n2026-01-01T00:00:00,ICU\n2026-01-01T05:00:00,ICU\n")
    with pytest.raises(ValueError, match="Too few hours"):
        engine.ingest(str(path), "too short")
    assert engine.dataset_status().first().rows == HOURS


def test_readings_with_profile_method(spark, tmp_path):
    lines = ["timestamp,admissions,discharges,icu_occupied,ward_occupied,emergency_occupied,pediatric_occupied"]
    lines += [f"2026-01-{1 + i // 24:02d}T{i % 24:02d}:00:00,{i % 5},{i % 4},{40 + i % 9},{200 + i % 50},60,30" for i in range(200)]
    path = tmp_path / "r.csv"
    path.write_text("\n".join(lines))
    engine = OccupancyEngine(spark, str(tmp_path / "root"), method="profile")
    with pytest.raises(ValueError):
        engine.ingest_text("a,b", "readings")
    assert engine.ingest_text("\n".join(lines), "posted").first().rows == 200
    assert engine.ingest(str(path), "readings", derive_outbreak="when_absent").first().source_type == "aggregate_his"
    found = engine.alerts(24, 0.7).collect()
    assert {r.department for r in found} == {"icu", "ward", "emergency"}
    assert engine.alert_history().count() == 3


def test_stream_equals_batch_on_closed_hours(spark, small_dir):
    streamed = REGISTERED["stream_hourly_flow"](spark, small_dir)
    batch = REGISTERED["hourly_flow"](spark, small_dir)
    assert streamed.exceptAll(batch).isEmpty()
    closed_until = streamed.agg(F.max("ts")).first()[0]
    busy = batch.where((F.col("ts") <= closed_until) & (F.col("admissions") + F.col("discharges") > 0))
    assert busy.exceptAll(streamed).isEmpty() and streamed.count() > 500


def test_text_comes_through_whole(spark, tmp_path):
    engine = OccupancyEngine(spark, str(tmp_path / "root"), method="profile")
    lines = ["visit_id,Admit Time,ward,visit_type"]
    lines += [f'{i},{w[0].isoformat()},"Unit {i}\u2028\nsecond line, ""north""",Routine' for i, w in enumerate(visit_rows(120))]
    lines += ["x,not a time,ICU,Routine", "y,,ICU,Routine", "short,2025-05-01T00:00:00"]
    status = engine.ingest_text("\n".join(lines), "quoted", kind="event").first()
    assert status.rejected_rows == 2
    assert engine.hourly().agg(F.sum("admissions")).first()[0] == 121
    raw = spark.read.parquet(str(tmp_path / "root" / "raw" / "event"))
    assert raw.where("ward like 'Unit %north\"'").count() == 120
    with pytest.raises(ValueError, match="more fields"):
        engine.ingest_text("\n".join([*lines, "z,2025-05-01T00:00:00,ICU,Routine,extra"]), "wide", kind="event")
    assert engine.dataset_status().first().source_name == "quoted"


def test_short_facilities_stay_and_are_named(spark, tmp_path):
    rows = [f"long,{a.isoformat()},{b.isoformat()},ICU" for a, b, *_ in visit_rows(120)] + ["brief,2025-05-01T00:00:00,2025-05-01T05:00:00,ICU"]
    text = "\n".join(["facility_id,admission_time,discharge_time,department", *rows])
    engine = OccupancyEngine(spark, str(tmp_path / "root"), learner={"maxIter": 1, "maxDepth": 2})
    status = {r.facility_id: r for r in engine.ingest_text(text, "two houses").collect()}
    assert set(status) == {"long", "brief"} and status["brief"].rows == 6 and status["brief"].model_metrics is None
    assert [(r.facility_id, r.rows) for r in engine.issues().collect()] == [("brief", 6)]
    with pytest.raises(ValueError, match="Too few hours"):
        engine.ingest_text(text, "two houses", strict=True)
