import pytest
from pyspark.sql import functions as F

from bedtide.operators import quality, state
from bedtide.session import materialise
from bedtide.streaming import flow

T = {i: f"2026-01-0{i} 00:00:00" for i in range(1, 8)}
ALERT = "facility_id string, scenario_id bigint, department string, label string, timestamp string, utilization double, threshold double, severity string, message string"
PAYLOAD = ("facility_id string, id bigint, name string, description string, admissions_multiplier double, discharges_multiplier double, "
           "emergency_multiplier double, outbreak_delta double, occupancy_delta double, duration_hours int")


def empty(spark, name):
    return spark.createDataFrame([], state.SCHEMAS[name])


def alert(spark, rows):
    return spark.createDataFrame(rows, ALERT)


def payload(facility, id_=None, name="surge", **changes):
    row = dict(admissions_multiplier=1.0, discharges_multiplier=1.0, emergency_multiplier=1.0, outbreak_delta=0.0, occupancy_delta=0.0, duration_hours=48, description="") | changes
    return (facility, id_, name, row["description"], row["admissions_multiplier"], row["discharges_multiplier"], row["emergency_multiplier"], row["outbreak_delta"], row["occupancy_delta"], row["duration_hours"])


def test_default_thresholds_do_not_overwrite(spark):
    facilities = spark.createDataFrame([("a",), ("b",)], "facility_id string")
    first = state.default_thresholds(facilities, None, "admin", T[1])
    assert first.count() == 8 and first.agg(F.min("utilization_threshold")).first()[0] == 0.9
    stored = first.where("facility_id = 'a' AND department <> 'icu'")
    assert state.default_thresholds(facilities, stored, "admin", T[2]).count() == 5


def test_threshold_merge_last_wins(spark):
    schema = state.SCHEMAS["thresholds"]
    old = spark.createDataFrame([("a", "icu", 0.9, "x")], "facility_id string, department string, utilization_threshold double, updated_by string").withColumn("updated_at", state.at(T[1]))
    new = spark.createDataFrame([("a", "icu", 0.7, "y"), ("a", "ward", 0.8, "y")], "facility_id string, department string, utilization_threshold double, updated_by string").withColumn("updated_at", state.at(T[1]))
    merged = state.merge_thresholds(old, new)
    assert {(r.department, r.utilization_threshold) for r in merged.collect()} == {("icu", 0.7), ("ward", 0.8)}
    assert state.merge_thresholds(merged, new).exceptAll(merged).isEmpty()
    assert [r.department for r in state.list_thresholds(merged).collect()] == ["icu", "ward"]
    assert set(merged.columns) == {f.split()[0] for f in schema.split(", ")}


def test_threshold_requests_are_all_or_nothing(spark):
    capacity = spark.createDataFrame([("a", "icu", 50), ("a", "ward", 260)], "facility_id string, department string, capacity int")
    updates = spark.createDataFrame(
        [(1, "a", "icu", 0.49), (1, "a", "ward", 0.9), (2, "a", "icu", 1.0), (3, "a", "burns", 0.9), (4, "a", "ward", 1.01), (5, "a", "ward", 0.5)],
        "request_id int, facility_id string, department string, utilization_threshold double")
    broken = quality.threshold_violations(updates, capacity)
    assert {r.request_id for r in broken.collect()} == {1, 3, 4}
    assert "Unknown department: burns" in {r.violation for r in broken.collect()}
    assert {r.request_id for r in quality.accepted_updates(updates, capacity).collect()} == {2, 5}


def test_alert_upsert(spark):
    rows = [("a", 0, "icu", "ICU", "t1", 0.95, 0.9, "warning", "m1"), ("a", 0, "ward", "Ward", "t1", 0.97, 0.9, "critical", "m2"), ("a", 5, "ward", "Ward", "t1", 1.0, 0.9, "critical", "what-if")]
    first = materialise(state.merge_alerts(empty(spark, "alert_history"), state.alert_rows(alert(spark, rows), T[1])))
    assert [(r.id, r.department) for r in first.orderBy("id").collect()] == [(1, "ward"), (2, "icu")]
    again = [("a", 0, "icu", "renamed", "t1", 0.99, 0.9, "critical", "m3"), ("a", 0, "icu", "ICU", "t2", 0.91, 0.9, "warning", "m4"), ("b", 0, "icu", "ICU", "t1", 0.91, 0.9, "warning", "m5")]
    second = materialise(state.merge_alerts(first, state.alert_rows(alert(spark, again), T[2])))
    got = {(r.facility_id, r.department, r.forecast_timestamp): r for r in second.collect()}
    assert len(got) == 4
    changed = got["a", "icu", "t1"]
    assert (changed.id, changed.label, changed.utilization, changed.message) == (2, "ICU", 0.99, "m3")
    assert got["a", "icu", "t2"].id == 3 and got["b", "icu", "t1"].id == 1
    third = materialise(state.merge_alerts(second, state.alert_rows(alert(spark, again), T[2])))
    assert third.exceptAll(second).isEmpty() and second.exceptAll(third).isEmpty()
    assert [r.forecast_timestamp for r in state.alert_history(third, 2, "a").collect()] == ["t2", "t1"]
    with pytest.raises(ValueError):
        state.alert_history(third, 0)


def test_scenario_life(spark):
    make = lambda *rows: spark.createDataFrame(list(rows), PAYLOAD)
    one = materialise(state.merge_scenarios(empty(spark, "scenarios"), make(payload("a", name="first"), payload("a", name="second"), payload("b", name="other")), "ann", T[1]))
    assert {(r.facility_id, r.name): r.id for r in one.collect()} == {("a", "first"): 1, ("a", "second"): 2, ("b", "other"): 1}
    change = make(payload("a", 2, "changed", occupancy_delta=7.0), payload("b", 9, "lost"))
    assert [r.id for r in state.unknown_scenarios(one, change).collect()] == [9]
    two = materialise(state.merge_scenarios(one, change, "bob", T[2]))
    row = two.where("facility_id = 'a' AND id = 2").first()
    assert (row.name, row.occupancy_delta, row.created_by, str(row.created_at), str(row.updated_at)) == ("changed", 7.0, "ann", T[1], T[2])
    assert two.count() == 3
    ran = materialise(state.record_last_run(two, spark.createDataFrame([("a", 1, '{"generated_at":"now","summary":[]}')], "facility_id string, id bigint, summary_json string"), T[3]))
    kept = materialise(state.merge_scenarios(ran, make(payload("a", 1, "renamed")), "bob", T[4]))
    found = state.get_scenario(kept, "a", 1).first()
    assert (found.name, found.last_run_summary.generated_at, str(found.last_run_at)) == ("renamed", "now", T[3])
    assert [r.id for r in state.list_scenarios(kept.where("facility_id = 'a'")).collect()] == [1, 2]
    gone = state.delete_scenarios(kept, spark.createDataFrame([("a", 2), ("z", 1)], "facility_id string, id bigint"))
    assert gone.count() == 2
    last = spark.createDataFrame([("a", 2)], "facility_id string, last_id bigint")
    assert state.merge_scenarios(gone, make(payload("a", name="new")), "ann", T[5], last).agg(F.max("id")).first()[0] == 3


def test_scenario_bounds(spark):
    rows = [
        payload("a", name="ok!"), payload("a", name="no"), payload("a", name="x" * 81), payload("a", description="d" * 241),
        payload("a", admissions_multiplier=0.1), payload("a", discharges_multiplier=5.1), payload("a", emergency_multiplier=None),
        payload("a", outbreak_delta=-1.5), payload("a", occupancy_delta=101.0, duration_hours=5), payload("a", duration_hours=169),
    ]
    df = spark.createDataFrame(rows, PAYLOAD)
    assert sorted(r.violation for r in quality.scenario_violations(df).collect()) == sorted([
        "name", "name", "description", "admissions_multiplier", "discharges_multiplier", "emergency_multiplier",
        "outbreak_delta", "occupancy_delta", "duration_hours", "duration_hours"])
    assert quality.valid_scenarios(df).count() == 1


def test_settings_and_metadata(spark):
    schema = "key string, value string, updated_at string"
    old = spark.createDataFrame([("k", "1", T[1]), ("l", "2", T[3])], schema)
    new = spark.createDataFrame([("k", "3", T[2]), ("k", "4", T[2]), ("l", "0", T[2]), ("m", "5", T[1])], schema)
    merged = state.merge_settings(old, new)
    assert {r.key: r.value for r in merged.collect()} == {"k": "4", "l": "2", "m": "5"}
    assert state.get_setting(merged, "m") == "5" and state.get_setting(merged, "q", "d") == "d"
    log = spark.createDataFrame([("a", "x", T[1]), ("a", "y", T[2]), ("b", "z", T[1])], "facility_id string, source_name string, recorded_at string")
    assert {r.facility_id: r.source_name for r in state.latest_metadata(log).collect()} == {"a": "y", "b": "z"}


def test_log_keeps_the_newest_undeleted_row(spark, tmp_path):
    root = str(tmp_path)
    state.create_log(spark, root, "settings")
    state.create_log(spark, root, "settings")
    put = lambda v, t, **k: state.append_log(spark.createDataFrame([("k", v, None)], "key string, value string, updated_at timestamp"), root, "settings", t, **k)
    assert state.read_state(spark, root, "settings").isEmpty()
    put("1", T[1]), put("2", T[2])
    assert state.get_setting(state.read_state(spark, root, "settings"), "k") == "2"
    put("2", T[3], deleted=True)
    assert state.read_state(spark, root, "settings").isEmpty()


def test_alert_stream_is_idempotent(spark, tmp_path):
    rows = state.alert_rows(alert(spark, [("a", 0, "icu", "ICU", "t1", 0.95, 0.9, "warning", "m1"), ("a", 0, "ward", "Ward", "t1", 0.97, 0.9, "critical", "m2")]), T[1])
    rows.write.parquet(str(tmp_path / "in"))
    root = str(tmp_path / "state")
    for run in ("one", "two"):
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        flow.alert_sink(stream, root, str(tmp_path / run), T[2]).awaitTermination()
        history = state.read_state(spark, root, "alert_history").orderBy("id").collect()
        assert [(r.id, r.department) for r in history] == [(1, "ward"), (2, "icu")]


def test_argument_checks():
    assert [quality.clamp_horizon(h) for h in (1, 48, 500)] == [6, 48, 168]
    assert [quality.clamp_history(h) for h in (1, 48, 500)] == [24, 48, 336]
    for check, value in [(quality.check_horizon, 5), (quality.check_horizon, 169), (quality.check_history, 23), (quality.check_history, 337),
                         (quality.check_limit, 201), (quality.check_threshold, 0.49), (quality.check_threshold, 1.01),
                         (quality.check_department, "burns"), (quality.check_dataset_name, "ab"), (quality.check_dataset_name, "x" * 121),
                         (quality.check_csv_text, "short")]:
        with pytest.raises(ValueError):
            check(value)
    assert quality.check_horizon(None) is None and quality.check_threshold(0.5) == 0.5


def test_equal_stamps_go_to_the_later_write(spark, tmp_path):
    root = str(tmp_path)
    state.create_log(spark, root, "settings")
    for value in ("one", "two", "three"):
        state.append_log(spark.createDataFrame([("k", value, None)], "key string, value string, updated_at timestamp"), root, "settings", T[1])
        assert state.get_setting(state.read_state(spark, root, "settings"), "k") == value


def test_later_batch_updates_a_known_alert(spark, tmp_path):
    folder, root = str(tmp_path / "in"), str(tmp_path / "state")
    for utilization in (0.91, 0.95, 0.93):
        rows = state.alert_rows(alert(spark, [("a", 0, "icu", "ICU", "t1", utilization, 0.9, "warning", str(utilization))]), T[1])
        rows.coalesce(1).write.mode("append").parquet(folder)
        flow.alert_sink(spark.readStream.schema(rows.schema).parquet(folder), root, str(tmp_path / "log"), T[2]).awaitTermination()
        assert [(r.id, r.utilization, r.message) for r in state.read_state(spark, root, "alert_history").collect()] == [(1, utilization, str(utilization))]


def test_history_is_limited_for_each_facility(spark):
    rows = [(i, f, "icu", "ICU", f"t{i}", 0.9, 0.9, "warning", "m", T[1]) for f in "ab" for i in range(1, 5)]
    history = spark.createDataFrame(rows, "id bigint, facility_id string, department string, label string, forecast_timestamp string, utilization double, threshold double, severity string, message string, created_at string")
    assert [(r.facility_id, r.position, r.id) for r in state.alert_history(history, 2).collect()] == [("a", 1, 4), ("a", 2, 3), ("b", 1, 4), ("b", 2, 3)]
    assert [r.id for r in state.alert_history(history, 3, "b").collect()] == [4, 3, 2]


def test_repeated_scenario_keys(spark):
    rows = spark.createDataFrame([payload("a", 1), payload("a", 1), payload("b", 1), payload("a"), payload("a")], PAYLOAD)
    assert [(r.facility_id, r.id) for r in state.repeated_scenarios(rows).collect()] == [("a", 1)]
