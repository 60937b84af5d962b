"""Registered queries: every operator over whole test tables, in presentation types."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bedtide import config as C
from bedtide.functions import scalar as S
from bedtide.operators import alerts as A
from bedtide.operators import capacity, features, forecast, hourly, intervals, kpis, profile, quality, ridge, scenarios, span, state, stays, trends
from bedtide.operators.recursive import gbt_forecast
from bedtide.operators.training import ForecastModels, model_metrics, train_all
from bedtide.plans.engine import OccupancyEngine
from bedtide.session import materialise, scratch_path, utc
from bedtide.sources import adapters, derived, readers, staging, timeformats
from bedtide.sources.sinks import dataset_manifest
from bedtide.streaming import flow, running

Query = Callable[[SparkSession, str], DataFrame]
HORIZON, OVERRIDE = 48, 0.6
NOW = {1: "2024-03-01 08:00:00", 2: "2024-03-02 08:00:00", 3: "2024-03-03 08:00:00", 4: "2024-03-04 08:00:00"}


def events(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.encounters_from_events(spark, sf)


def fact(spark: SparkSession, sf: str, urgency: str = "reference") -> DataFrame:
    return hourly.hourly_from_encounters(events(spark, sf), urgency)


def shared_fact(spark: SparkSession, sf: str) -> DataFrame:
    """The hourly fact as a written table, for plans that read it several times."""
    return materialise(fact(spark, sf))


def _iso(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: S.iso(F.col(c)) for c in columns})


def _rounded(df: DataFrame, columns: list[str], digits: int = 6, nudge: float = 0.0) -> DataFrame:
    """``nudge`` moves means of decimals, which end in a 5 after the last digit kept, off the rounding edge,
    where the order of summation would decide."""
    return df.withColumns({c: F.round(F.col(c).cast("double") + F.lit(nudge), digits) for c in columns})


def _whole(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})


# --- encounters --------------------------------------------------------------------------------------
def encounters_clean(spark, sf):
    micros = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    clean = stays.clean_encounters(events(spark, sf))
    return _whole(
        _iso(clean, "admission_bucket", "discharge_bucket").withColumns(
            {c: micros(c) for c in ["admission_time", "discharge_time"]}
        ),
        "discharge_imputed", "is_emergency",
    )


def _mapping(encounters: DataFrame) -> DataFrame:
    pairs = encounters.groupBy("department", "admission_type").agg(F.count(F.lit(1)).alias("encounters"))
    mapped = pairs.withColumn("mapped_department", S.map_department(F.col("department"), F.col("admission_type")))
    return mapped.withColumns({
        "is_emergency": S.is_emergency_case(F.col("mapped_department"), F.col("admission_type")).cast("bigint"),
        "is_emergency_by_word": S.is_emergency_case(F.col("mapped_department"), F.col("admission_type"), "word").cast("bigint"),
    })


def department_mapping(spark, sf):
    return _mapping(events(spark, sf))


def department_mapping_orders(spark, sf):
    return _mapping(adapters.encounters_from_orders(spark, sf))


def default_stay(spark, sf):
    return stays.default_stays(events(spark, sf)).drop("default_stay_micros")


def default_stay_orders(spark, sf):
    return stays.default_stays(adapters.encounters_from_orders(spark, sf)).drop("default_stay_micros")


def default_stay_sketch(spark, sf):
    """The exact median stay beside that of a sketch: whether the sketch's rank is within 2 % of the middle."""
    lengths = materialise(stays.stay_lengths(events(spark, sf)))
    exact, errors = stays.median_stays(lengths), stays.rank_errors(lengths, stays.sketched_median_stays(lengths))
    found = exact.select("facility_id", (F.col("median_micros") / F.lit(float(S.MICROS_PER_HOUR))).alias("median_hours")).join(errors, "facility_id")
    return found.select("facility_id", F.round("median_hours", 6).alias("median_hours"), "rows", (F.col("rank_error") <= 0.02).cast("bigint").alias("is_close"))


# --- text files ----------------------------------------------------------------------------------------
def time_formats(spark, sf):
    """Encounters read back from CSV files with four layouts of times and other headers."""
    rows = readers.read_encounters(spark, derived.event_exports(spark, sf))
    return _iso(rows, "admission_time", "discharge_time")


def time_votes(spark, sf):
    """What each layout reads in each file, and which is chosen."""
    raw = readers.read_raw(spark, derived.event_exports(spark, sf), with_file=True)
    found = timeformats.vote_table(raw, ["Admission Time", "Departure-Time"], [readers.FILE, "facility_id"])
    return _whole(found.drop(readers.FILE), "chosen")


def _spoiled(spark, sf) -> tuple[str, dict[str, int]]:
    raw = readers.read_raw(spark, derived.event_exports(spark, sf, True), with_file=True)
    path = scratch_path(spark, "staged")
    return path, staging.write_staged(staging.staged(raw, "event"), path)


def rejected_rows(spark, sf):
    """Records that an ingest sets aside, with the reason; each is of one of the files."""
    found = staging.quarantine(spark, _spoiled(spark, sf)[0])
    return _whole(found.withColumn("file", F.col("file").endswith(".csv")).withColumnRenamed("file", "has_file"), "has_file")


def ingest_report(spark, sf):
    """What was counted while accepted and refused rows were written, beside what there is to read."""
    path, counted = _spoiled(spark, sf)
    rows = staging.accepted(spark, path)
    return rows.agg(F.count(F.lit(1)).alias("readable"), F.count("discharge_time").alias("discharges")).select(
        "*", *(F.lit(n).cast("bigint").alias(name) for name, n in counted.items()))


# --- hourly fact ---------------------------------------------------------------------------------------
def _flow(occupancy: DataFrame) -> DataFrame:
    return _iso(occupancy, "ts").select("facility_id", "ts", *hourly.FLOWS)


def hourly_flow(spark, sf):
    return _flow(hourly.hourly_occupancy(stays.clean_encounters(events(spark, sf))))


def hourly_flow_word_urgency(spark, sf):
    return _flow(hourly.hourly_occupancy(stays.clean_encounters(events(spark, sf), "word")))


def hourly_occupancy(spark, sf):
    return _iso(hourly.by_department(hourly.hourly_occupancy(stays.clean_encounters(events(spark, sf)))), "ts")


def hourly_total(spark, sf):
    df = hourly.by_column(hourly.by_department(hourly.hourly_occupancy(stays.clean_encounters(events(spark, sf)))))
    total = sum((F.col(c) for c in C.OCCUPANCY_COLUMNS), F.lit(0.0))
    return _iso(df.withColumn("total_occupied", total), "ts")


def occupancy_by_overlap(spark, sf):
    return _iso(hourly.occupancy_by_overlap(stays.clean_encounters(events(spark, sf))), "ts")


def occupancy_by_range_join(spark, sf):
    return _iso(intervals.occupancy_by_range_join(stays.clean_encounters(events(spark, sf))), "ts")


def occupancy_by_range_join_volume(spark, sf):
    return _iso(intervals.occupancy_by_range_join(_volume(spark, sf)), "ts")


def _spanned(spark, sf):
    """Encounters with strays among them, and the span of each facility."""
    strays = materialise(derived.stray_encounters(spark, sf))
    return strays, materialise(span.main_spans(strays))


def robust_hours(spark, sf):
    """Hourly occupancy of the encounters within each facility's span."""
    strays, spans = _spanned(spark, sf)
    return _iso(hourly.by_department(hourly.hourly_occupancy(stays.clean_encounters(span.within_span(strays, spans)))), "ts")


def span_issues(spark, sf):
    return _iso(span.span_issues(*_spanned(spark, sf)), "first_time", "last_time")


def _volume(spark, sf):
    """Order encounters, joined once and written: both the default stays and the hours are read from them."""
    return stays.clean_encounters(materialise(adapters.encounters_from_orders(spark, sf).drop("patient_id")))


def hourly_occupancy_volume(spark, sf):
    return _iso(hourly.by_department(hourly.hourly_occupancy(_volume(spark, sf))), "ts")


def hourly_flow_volume(spark, sf):
    return _flow(hourly.hourly_occupancy(_volume(spark, sf)))


LEVELS = ["outbreak_signal", *C.OCCUPANCY_COLUMNS, "total_occupied"]


def hourly_readings(spark, sf):
    return _rounded(_iso(hourly.hourly_from_readings(adapters.readings_from_events(spark, sf)), "ts"), LEVELS, nudge=1e-9)


def hourly_readings_derived(spark, sf):
    df = hourly.hourly_from_readings(adapters.readings_from_events(spark, sf), "when_absent")
    return _rounded(_iso(df, "ts"), LEVELS, nudge=1e-9)


def outbreak_signal(spark, sf):
    return _rounded(_iso(fact(spark, sf).select("facility_id", "ts", "outbreak_signal"), "ts"), ["outbreak_signal"])


def capacities(spark, sf):
    return capacity.capacities(hourly.hourly_occupancy(stays.clean_encounters(events(spark, sf))))


def _metadata(spark, sf):
    return capacity.dataset_metadata(
        hourly.hourly_occupancy(stays.clean_encounters(events(spark, sf))), "events", "event_level_his"
    )


def dataset_metadata(spark, sf):
    return _metadata(spark, sf)


def manifest(spark, sf):
    return dataset_manifest(_metadata(spark, sf), events(spark, sf), "Facility")


def series_lengths(spark, sf):
    return _whole(quality.series_lengths(hourly.hourly_occupancy(stays.clean_encounters(events(spark, sf)))), "is_short")


def display_lines(spark, sf):
    occupancy = hourly.hourly_occupancy(stays.clean_encounters(events(spark, sf)))
    lines = capacity.capacity_lines(capacity.dataset_metadata(occupancy, "events", "event_level_his"))
    return capacity.threshold_lines(capacity.capacities(occupancy)).join(lines, "facility_id")


# --- overview and trends ----------------------------------------------------------------------------------
def overview_departments(spark, sf):
    return _whole(kpis.overview_departments(fact(spark, sf)), "is_critical")


def overview_departments_as_of(spark, sf):
    return _whole(kpis.overview_departments(hourly.up_to_last_admission(fact(spark, sf))), "is_critical")


def overview_hospital(spark, sf):
    return kpis.overview_hospital(fact(spark, sf))


def overview_hospital_as_of(spark, sf):
    return kpis.overview_hospital(hourly.up_to_last_admission(fact(spark, sf)))


def overview_rollup(spark, sf):
    return kpis.overview_rollup(fact(spark, sf))


def overview_analytics(spark, sf):
    return kpis.overview_analytics(shared_fact(spark, sf))


def occupancy_history(spark, sf):
    return _whole(trends.occupancy_history(fact(spark, sf)), "position")


def occupancy_history_downsampled(spark, sf):
    return _whole(trends.downsample(trends.occupancy_history(fact(spark, sf))), "position")


def daily_flow(spark, sf):
    return trends.daily_flow(fact(spark, sf))


# --- features and profile ------------------------------------------------------------------------------------
def calendar_features(spark, sf):
    df = features.calendar_features(hourly.hourly_occupancy(stays.clean_encounters(events(spark, sf))))
    counts = C.CALENDAR_FEATURES[:4]
    angles = C.CALENDAR_FEATURES[4:]
    return _rounded(_whole(_iso(df, "ts").select("facility_id", "ts", *counts, *angles), *counts), angles)


def training_frame(spark, sf):
    counts = [*C.CALENDAR_FEATURES[:4], *C.EXOGENOUS[:3]]
    rest = ["target", *[c for c in C.FEATURES if c not in counts]]
    return _rounded(_whole(_iso(features.training_frame(fact(spark, sf)), "ts"), *counts), rest)


def train_validation_split(spark, sf):
    split = features.time_split(features.training_frame(fact(spark, sf)))
    return _whole(_iso(split, "ts").select("facility_id", "department", "ts", "is_train"), "is_train")


def observed_range(spark, sf):
    return features.observed_range(features.training_frame(fact(spark, sf)))


def exogenous_profile(spark, sf):
    return _rounded(_whole(profile.exogenous_profile(fact(spark, sf)), "dow", "hour"), C.EXOGENOUS)


def dense_profile(spark, sf):
    return _rounded(_whole(profile.dense_profile(fact(spark, sf)), "dow", "hour", "profile_fallback"), C.EXOGENOUS)


def _all_scenarios(spark, sf, hours):
    columns = scenarios.SCENARIO_COLUMNS
    plain = scenarios.baseline(scenarios.facilities_of(hours)).select(*columns)
    return plain.unionByName(derived.what_if_scenarios(spark, sf).select(*columns))


def future_frame(spark, sf):
    hours = shared_fact(spark, sf)
    df = scenarios.future_frame(hours, _all_scenarios(spark, sf, hours), HORIZON)
    counts = ["step", "active", "profile_fallback", *C.CALENDAR_FEATURES[:4]]
    smooth = ["occupancy_delta", "outbreak_signal", *C.CALENDAR_FEATURES[4:]]
    # Means of scaled counts end within eight decimals, so six would put some of them on a rounding edge.
    means = [*C.EXOGENOUS[:3], *C.EXOGENOUS_ROLLING_FEATURES]
    return _rounded(_rounded(_whole(_iso(df, "ts"), *counts), smooth), means, 9)


# --- profile forecast, alerts, what-if --------------------------------------------------------------------------
def _points(spark, sf, horizon: int | None = HORIZON, baseline_only: bool = False):
    hours = shared_fact(spark, sf)
    chosen = scenarios.baseline(scenarios.facilities_of(hours)) if baseline_only else _all_scenarios(spark, sf, hours)
    return forecast.profile_forecast(hours, chosen, horizon)


def profile_errors(spark, sf):
    return _rounded(forecast.profile_errors(fact(spark, sf)), ["rmse"])


def profile_forecast(spark, sf):
    return _whole(_points(spark, sf), "step")


def profile_forecast_own_horizon(spark, sf):
    return _whole(_points(spark, sf, None), "step")


def forecast_summary(spark, sf):
    return _whole(forecast.forecast_summary(_points(spark, sf, 168, True)), "horizon_hours")


def what_if_summary(spark, sf):
    return forecast.scenario_summary(_points(spark, sf))


def _stored_thresholds(spark, sf, hours: DataFrame | None = None):
    if hours is None:
        hours = hourly.hourly_occupancy(stays.clean_encounters(events(spark, sf)))
    known = materialise(capacity.capacities(hours))
    seeds = state.default_thresholds(scenarios.facilities_of(known), None, "admin", "2024-01-01 00:00:00")
    accepted = quality.accepted_updates(derived.threshold_updates(spark, sf), known).drop("request_id")
    return state.merge_thresholds(seeds, accepted)


def _points_as_of(spark, sf):
    """Baseline points from the series as it stood at the last admission."""
    hours = materialise(hourly.up_to_last_admission(hourly.hourly_occupancy(stays.clean_encounters(events(spark, sf)))))
    return forecast.profile_forecast(hours, scenarios.baseline(scenarios.facilities_of(hours)), HORIZON), hours


def alerts(spark, sf):
    points, hours = _points_as_of(spark, sf)
    return _whole(A.compute_alerts(points, _stored_thresholds(spark, sf, hours)), "position")


def alerts_override(spark, sf):
    return _whole(A.compute_alerts(_points_as_of(spark, sf)[0], None, OVERRIDE), "position")


def what_if_alerts(spark, sf):
    hours = shared_fact(spark, sf)
    points = forecast.profile_forecast(hours, _all_scenarios(spark, sf, hours), HORIZON)
    return _whole(A.compute_alerts(points, _stored_thresholds(spark, sf, hours)), "position")


# --- state tables -------------------------------------------------------------------------------------------------
def thresholds(spark, sf):
    return _iso(_stored_thresholds(spark, sf), "updated_at")


def thresholds_from_snapshot(spark, sf):
    """Thresholds written in three batches with two compactions between them, the last batch twice; beside each row, how many
    rows had to be read behind the snapshot."""
    root = scratch_path(spark, "thresholds")
    known = materialise(capacity.capacities(hourly.hourly_occupancy(stays.clean_encounters(events(spark, sf)))))
    accepted = materialise(quality.accepted_updates(derived.threshold_updates(spark, sf), known))
    put = lambda rows, now: state.append_log(rows, root, "thresholds", now)
    state.create_log(spark, root, "thresholds")
    put(state.default_thresholds(scenarios.facilities_of(known), None, "admin", "2024-01-01 00:00:00"), NOW[1])
    for number, now in enumerate((NOW[2], NOW[3], NOW[4])):
        batch = accepted.where(F.col("request_id") % 3 == number).drop("request_id")
        newest = state.latest(batch, state.THRESHOLD_KEY, F.struct("updated_at", "utilization_threshold", "updated_by"))
        put(newest, now)
        if number < 2:
            state.compact(spark, root, "thresholds")
        else:
            put(newest, now)
    tail = state.read_tail(spark, root, "thresholds").count()
    return _iso(state.read_state(spark, root, "thresholds"), "updated_at").withColumn("tail_rows", F.lit(tail).cast("bigint"))


def threshold_violations(spark, sf):
    known = capacity.capacities(hourly.hourly_occupancy(stays.clean_encounters(events(spark, sf))))
    return _rounded(
        _iso(quality.threshold_violations(derived.threshold_updates(spark, sf), known), "updated_at"),
        ["utilization_threshold"],
    )


def _history(spark, sf):
    forecasted, hours = _points_as_of(spark, sf)
    points, stored = materialise(forecasted), materialise(_stored_thresholds(spark, sf, hours))
    history = spark.createDataFrame([], state.SCHEMAS["alert_history"])
    runs = [(stored, None, NOW[1]), (None, OVERRIDE, NOW[2]), (stored, None, NOW[3])]
    for limits, override, now in runs:
        found = state.alert_rows(A.compute_alerts(points, limits, override), now)
        history = materialise(state.merge_alerts(history, found))
    return history


def alert_merge(spark, sf):
    return _iso(_history(spark, sf), "created_at")


def alert_history(spark, sf):
    return _whole(_iso(state.alert_history(_history(spark, sf), 2), "created_at"), "position")


def _updates(spark, sf):
    """Three batches of history rows about the same alerts: each a little fuller than the one before."""
    forecasted, _ = _points_as_of(spark, sf)
    found = A.compute_alerts(forecasted, None, OVERRIDE)
    for step in (1, 2, 3):
        worse = found.withColumn("utilization", F.least(F.lit(1.0), F.col("utilization") + F.lit(0.01 * step)))
        yield state.alert_rows(worse, NOW[step])


def alert_stream_merge(spark, sf):
    """A stream of three files, one a batch, merged into the history with one and the same stamp."""
    folder, root, log = (scratch_path(spark, f"alert-{x}") for x in ("batches", "state", "log"))
    for rows in _updates(spark, sf):
        rows.coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(rows.schema).parquet(folder)
        flow.alert_sink(stream, root, log, NOW[4]).awaitTermination()
    return _iso(state.read_state(spark, root, "alert_history"), "created_at")


def scenario_violations(spark, sf):
    return _whole(_rounded(quality.scenario_violations(derived.scenario_inserts(spark, sf)), list(C.SCENARIO_BOUNDS)), "duration_hours")


def _scenario_table(spark, sf):
    empty = spark.createDataFrame([], state.SCHEMAS["scenarios"])
    made = state.merge_scenarios(empty, quality.valid_scenarios(derived.scenario_inserts(spark, sf)), "admin", NOW[1])
    changed = state.merge_scenarios(
        materialise(made), quality.valid_scenarios(derived.scenario_updates(spark, sf)), "editor", NOW[2]
    )
    changed = materialise(changed)
    gone = changed.join(derived.quietest_days(spark, sf), ["facility_id", "name"]).select(*state.SCENARIO_KEY)
    return state.delete_scenarios(changed, gone)


def scenario_table(spark, sf):
    df = _iso(_scenario_table(spark, sf), "created_at", "updated_at").drop("last_run_at", "last_run_summary")
    return _whole(_rounded(state.list_scenarios(df), list(C.SCENARIO_BOUNDS)), "duration_hours")


def scenario_runs(spark, sf):
    """All saved scenarios simulated in one job, and their summaries stored."""
    hours = shared_fact(spark, sf)
    stored = materialise(_scenario_table(spark, sf))
    chosen = stored.withColumnRenamed("id", "scenario_id").select(*scenarios.SCENARIO_COLUMNS)
    summary = forecast.scenario_summary(forecast.profile_forecast(hours, chosen, None))
    ran = state.record_last_run(stored, state.run_summaries(summary, NOW[3]), NOW[3])
    return _iso(ran.select("facility_id", "id", "name", "last_run_at", "updated_at", "last_run_summary"), "last_run_at", "updated_at")


def settings(spark, sf):
    return _iso(state.merge_settings(derived.order_settings(spark, sf), derived.event_settings(spark, sf)), "updated_at")


def metadata_history(spark, sf):
    occupancy = hourly.hourly_occupancy(stays.clean_encounters(events(spark, sf)))
    record = lambda hours, name, now: capacity.dataset_metadata(hours, name, "event_level_his").withColumn("recorded_at", state.at(now))
    log = record(hourly.up_to_last_admission(occupancy), "cut", NOW[1]).unionByName(record(occupancy, "whole", NOW[2]))
    return _iso(state.latest_metadata(log), "recorded_at")


# --- learned model ----------------------------------------------------------------------------------------------------
_TRAINED: dict[tuple[str, str], tuple[DataFrame, ForecastModels]] = {}


def trained(spark, sf) -> tuple[DataFrame, ForecastModels]:
    """Hourly fact and models, trained once per application and data folder, as a service would."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _TRAINED:
        hours = shared_fact(spark, sf)
        _TRAINED[key] = hours, train_all(hours)
    return _TRAINED[key]


def trained_metrics(spark, sf):
    return model_metrics(trained(spark, sf)[1])


def _gbt_points(spark, sf, baseline_only=False):
    hours, models = trained(spark, sf)
    chosen = scenarios.baseline(scenarios.facilities_of(hours)) if baseline_only else _all_scenarios(spark, sf, hours)
    return gbt_forecast(hours, models, chosen, HORIZON)


def gbt_forecast_points(spark, sf):
    return _gbt_points(spark, sf, True)


def gbt_checks(spark, sf):
    """What must hold for learned points, whatever the trees: their number and span, and how many break a bound."""
    hours, models = trained(spark, sf)
    points = _gbt_points(spark, sf)
    bounds = (F.col("lower") >= 0) & (F.col("lower") <= F.col("occupied")) & (F.col("occupied") <= F.col("upper")) & (F.col("upper") <= F.col("capacity"))
    errors = models.metrics.select("facility_id", "department", "rmse")
    return points.join(errors, ["facility_id", "department"]).groupBy("facility_id", "scenario_id", "department").agg(
        F.count(F.lit(1)).alias("points"), F.min("timestamp").alias("first_timestamp"), F.max("timestamp").alias("last_timestamp"),
        F.count(F.when(~F.coalesce(bounds, F.lit(False)), 1)).alias("out_of_bounds"),
        F.count(F.when(~F.coalesce(F.col("rmse") >= C.RMSE_FLOOR, F.lit(False)), 1)).alias("under_floor"), F.max("capacity").cast("bigint").alias("capacity"),
    )


def gbt_alerts(spark, sf):
    return A.compute_alerts(_gbt_points(spark, sf), _stored_thresholds(spark, sf, trained(spark, sf)[0]))


def gbt_what_if(spark, sf):
    return forecast.scenario_summary(_gbt_points(spark, sf))


# --- the engine, end to end --------------------------------------------------------------------------------------------------
_ENGINES: dict[tuple[str, str], OccupancyEngine] = {}
AS_OF = "2024-01-20 00:00:00"


def installed(spark, sf) -> OccupancyEngine:
    """An engine that has ingested the events' encounters, once per application and data folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _ENGINES:
        path = scratch_path(spark, "delivery")
        adapters.event_encounters(adapters.table(spark, sf, "events")).write.parquet(path)
        engine = OccupancyEngine(spark, scratch_path(spark, "engine"), method="profile")
        engine.ingest(path, "Events export", fmt="parquet")
        _ENGINES[key] = engine
    return _ENGINES[key]


def engine_status(spark, sf):
    return installed(spark, sf).dataset_status()


def engine_dashboard(spark, sf):
    """What one screen shows of each department: figures of now, the peak to come, and the threshold."""
    screen = installed(spark, sf).dashboard(HORIZON)
    now = screen["overview"]["departments"].drop("label", "capacity", "is_critical")
    peaks = screen["summaries"].select("facility_id", "department", "label", "capacity", "horizon_hours", "peak_occupancy", "peak_timestamp")
    rows = peaks.join(now, ["facility_id", "department"]).join(screen["thresholds"], ["facility_id", "department"])
    return _whole(rows.join(screen["overview"]["analytics"].select("facility_id", "peak_admission_hour", "busiest_day"), "facility_id"), "horizon_hours")


def engine_alerts(spark, sf):
    """Alerts found as of a time, as the history then lists them; finding them twice changes nothing."""
    root = scratch_path(spark, "engine")
    engine = installed(spark, sf).branch(root)
    for _ in range(2):
        engine.alerts(HORIZON, OVERRIDE, as_of=AS_OF)
    return _whole(engine.alert_history(200).drop("created_at"), "position")


def engine_simulation(spark, sf):
    """Scenarios saved and simulated through the engine: the summaries returned, beside whether they were stored."""
    engine = installed(spark, sf).branch(scratch_path(spark, "engine"))
    engine.save_scenarios(quality.valid_scenarios(derived.scenario_inserts(spark, sf)))
    summary = engine.simulate(engine.scenarios().select(*state.SCENARIO_KEY))["summary"]
    stored = engine.scenarios().select("facility_id", F.col("id").alias("scenario_id"), "name", F.col("last_run_summary").isNotNull().cast("bigint").alias("is_stored"))
    return summary.join(stored, ["facility_id", "scenario_id"])


def engine_scenarios(spark, sf):
    """Saved scenarios as they stand after they ran: what is stored of each run, decoded."""
    engine = installed(spark, sf).branch(scratch_path(spark, "engine"))
    engine.save_scenarios(quality.valid_scenarios(derived.scenario_inserts(spark, sf)))
    engine.simulate(engine.scenarios().select(*state.SCENARIO_KEY))
    return state.decoded(engine.scenarios()).select("facility_id", "id", "name", F.inline("last_run_summary.summary")).withColumn("capacity", F.col("capacity").cast("bigint"))


# --- linear model ---------------------------------------------------------------------------------------------------------
def ridge_moments(spark, sf):
    """The sums a fit needs, as means a row, for each series and half of the split; features and target by their names."""
    found = ridge.moments(features.time_split(features.training_frame(shared_fact(spark, sf))))
    names = F.array(*[F.struct(F.lit(one).alias("one"), F.lit(other).alias("other")) for one, other in [
        *((c, "") for c in ridge.COLUMNS), *((ridge.COLUMNS[i], ridge.COLUMNS[j]) for i, j in ridge.PAIRS)]])
    rows = found.select(*ridge.KEY, "is_train", "n", F.posexplode(F.concat("sums", "products")).alias("at", "total"))
    rows = rows.withColumn("pair", F.get(names, F.col("at"))).select(*ridge.KEY, "is_train", "n", "pair.one", "pair.other", "total")
    return _rounded(_whole(rows.withColumn("mean", F.col("total") / F.col("n")).drop("total"), "is_train"), ["mean"], nudge=1e-9)


def _ridge(spark, sf):
    hours = shared_fact(spark, sf)
    return hours, ridge.train(hours)


def ridge_metrics(spark, sf):
    """Error of each series, and whether its normal equations hold to a millionth."""
    table = _ridge(spark, sf)[1].table
    return table.select(*ridge.KEY, F.round("rmse", 5).alias("rmse"), "capacity", "rows", (F.col("residual") < 1e-6).cast("bigint").alias("is_solved"))


def _ridge_points(spark, sf, baseline_only=False):
    hours, models = _ridge(spark, sf)
    chosen = scenarios.baseline(scenarios.facilities_of(hours)) if baseline_only else _all_scenarios(spark, sf, hours)
    return ridge.ridge_forecast(hours, models, chosen, HORIZON)


def ridge_forecast(spark, sf):
    return _whole(_ridge_points(spark, sf), "step")


def ridge_what_if(spark, sf):
    return forecast.scenario_summary(_ridge_points(spark, sf))


# --- streaming --------------------------------------------------------------------------------------------------------------
def stream_hourly_flow(spark, sf):
    utc(spark)
    batch = adapters.table(spark, sf, "events")
    stream = spark.readStream.schema(batch.schema).parquet(f"{sf}/events*.parquet")
    encounters = adapters.canonical_encounters(adapters.event_encounters(stream))
    closed = flow.stream_hourly_flow(encounters, stays.default_stays(events(spark, sf)))
    return _iso(flow.run_available(closed, scratch_path(spark, "stream"), scratch_path(spark, "stream-log")), "ts")


def stream_hourly_occupancy(spark, sf):
    """Occupancy of closed hours, carried in the state of a stream."""
    utc(spark)
    stream = spark.readStream.schema(adapters.table(spark, sf, "events").schema).parquet(f"{sf}/events*.parquet")
    encounters = adapters.canonical_encounters(adapters.event_encounters(stream))
    closed = running.stream_hourly_occupancy(encounters, materialise(stays.default_stays(events(spark, sf))))
    path = scratch_path(spark, "stream")
    running.run_occupancy(closed, path, scratch_path(spark, "stream-log"))
    return _iso(spark.read.schema(closed.schema).parquet(path), "ts")


REGISTERED: dict[str, Query] = {
    "stream_hourly_occupancy": stream_hourly_occupancy,
    "time_formats": time_formats,
    "time_votes": time_votes,
    "rejected_rows": rejected_rows,
    "ingest_report": ingest_report,
    "encounters_clean": encounters_clean,
    "department_mapping": department_mapping,
    "department_mapping_orders": department_mapping_orders,
    "default_stay": default_stay,
    "default_stay_orders": default_stay_orders,
    "hourly_flow": hourly_flow,
    "hourly_flow_word_urgency": hourly_flow_word_urgency,
    "hourly_occupancy": hourly_occupancy,
    "hourly_total": hourly_total,
    "occupancy_by_overlap": occupancy_by_overlap,
    "occupancy_by_range_join": occupancy_by_range_join,
    "occupancy_by_range_join_volume": occupancy_by_range_join_volume,
    "robust_hours": robust_hours,
    "span_issues": span_issues,
    "default_stay_sketch": default_stay_sketch,
    "overview_rollup": overview_rollup,
    "hourly_occupancy_volume": hourly_occupancy_volume,
    "hourly_flow_volume": hourly_flow_volume,
    "hourly_readings": hourly_readings,
    "hourly_readings_derived": hourly_readings_derived,
    "outbreak_signal": outbreak_signal,
    "capacities": capacities,
    "dataset_metadata": dataset_metadata,
    "manifest": manifest,
    "series_lengths": series_lengths,
    "display_lines": display_lines,
    "overview_departments": overview_departments,
    "overview_departments_as_of": overview_departments_as_of,
    "overview_hospital": overview_hospital,
    "overview_hospital_as_of": overview_hospital_as_of,
    "overview_analytics": overview_analytics,
    "occupancy_history": occupancy_history,
    "occupancy_history_downsampled": occupancy_history_downsampled,
    "daily_flow": daily_flow,
    "calendar_features": calendar_features,
    "training_frame": training_frame,
    "train_validation_split": train_validation_split,
    "observed_range": observed_range,
    "exogenous_profile": exogenous_profile,
    "dense_profile": dense_profile,
    "future_frame": future_frame,
    "profile_errors": profile_errors,
    "profile_forecast": profile_forecast,
    "profile_forecast_own_horizon": profile_forecast_own_horizon,
    "forecast_summary": forecast_summary,
    "what_if_summary": what_if_summary,
    "alerts": alerts,
    "alerts_override": alerts_override,
    "what_if_alerts": what_if_alerts,
    "thresholds": thresholds,
    "thresholds_from_snapshot": thresholds_from_snapshot,
    "threshold_violations": threshold_violations,
    "alert_merge": alert_merge,
    "alert_history": alert_history,
    "alert_stream_merge": alert_stream_merge,
    "scenario_violations": scenario_violations,
    "scenario_table": scenario_table,
    "scenario_runs": scenario_runs,
    "settings": settings,
    "metadata_history": metadata_history,
    "model_metrics": trained_metrics,
    "gbt_forecast": gbt_forecast_points,
    "gbt_checks": gbt_checks,
    "gbt_alerts": gbt_alerts,
    "gbt_what_if": gbt_what_if,
    "engine_status": engine_status,
    "engine_dashboard": engine_dashboard,
    "engine_alerts": engine_alerts,
    "engine_simulation": engine_simulation,
    "engine_scenarios": engine_scenarios,
    "ridge_moments": ridge_moments,
    "ridge_metrics": ridge_metrics,
    "ridge_forecast": ridge_forecast,
    "ridge_what_if": ridge_what_if,
    "stream_hourly_flow": stream_hourly_flow,
}
