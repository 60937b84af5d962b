"""The public surface: ingest, look, forecast, alert, simulate, administer. Results are DataFrames."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bedtide import config as C
from bedtide.operators import alerts as A
from bedtide.operators import forecast as FC
from bedtide.operators import kpis, quality, span, state, trends
from bedtide.operators.capacity import capacities, dataset_metadata
from bedtide.operators.hourly import hourly_from_encounters, hourly_from_readings, up_to
from bedtide.operators.recursive import gbt_forecast
from bedtide.operators.scenarios import SCENARIO_COLUMNS, baseline, facilities_of
from bedtide.operators.training import ForecastModels, model_metrics, train_all
from bedtide.session import materialise, scratch_path, utc
from bedtide.sources import sinks
from bedtide.sources.columns import sniff_kind
from bedtide.sources.readers import load_hourly, read_raw, too_many_fields
from bedtide.sources.staging import accepted, quarantine, write_staged
from bedtide.sources.staging import staged as stage_rows


def clock() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")


class OccupancyEngine:
    """All facilities of one folder: the hourly fact, the models and the state tables.

    ``root`` must be a folder every executor reaches. ``method`` picks the forecaster: ``"gbt"`` (learned,
    one model per department) or ``"profile"`` (weekly means, no training).
    """

    def __init__(self, spark: SparkSession, root: str, method: str = "gbt", learner: dict | None = None, user: str = "admin"):
        self.spark, self.root = utc(spark), root.rstrip("/")
        self.method, self.learner, self.user = method, learner or {}, user
        self.models: ForecastModels | None = None
        for name in state.SCHEMAS:
            state.create_log(spark, self._state_root, name)

    def branch(self, root: str) -> OccupancyEngine:
        """An engine at another root on the dataset installed here, with default thresholds and no scenarios, alerts or models."""
        other = OccupancyEngine(self.spark, root, self.method, self.learner, self.user)
        settings, now = self._state("settings"), clock()
        other._append(materialise(settings.withColumn("updated_at", state.at(now))), "settings")
        other._append(state.default_thresholds(facilities_of(other.hourly()), None, self.user, now), "thresholds")
        return other

    # --- places -------------------------------------------------------------------------------
    @property
    def _state_root(self) -> str:
        return f"{self.root}/state"

    @property
    def _hourly_path(self) -> str:
        """The hourly table in use; each ingest writes a new one, so running readers keep theirs."""
        path = state.get_setting(self._state("settings"), "hourly_path")
        if path is None:
            raise ValueError("No dataset has been ingested.")
        return path

    def _state(self, name: str) -> DataFrame:
        return state.read_state(self.spark, self._state_root, name)

    def _append(self, rows: DataFrame, name: str, deleted: bool = False) -> None:
        state.append_log(rows, self._state_root, name, clock(), deleted)

    def compact(self) -> dict[str, int]:
        """Make every state table a snapshot, so that reading it costs its keys and not its past; the generations."""
        return {name: state.compact(self.spark, self._state_root, name) for name in state.SCHEMAS}

    def _set(self, values: dict[str, str], now: str) -> None:
        """One write for all values: a reader sees them together or not at all."""
        rows = self.spark.createDataFrame(list(values.items()), "key string, value string").withColumn("updated_at", state.at(now))
        self._append(rows.coalesce(1), "settings")

    def hourly(self, as_of: str | None = None) -> DataFrame:
        fact = load_hourly(self.spark, self._hourly_path)
        return fact if as_of is None else up_to(fact, as_of)

    # --- ingest -------------------------------------------------------------------------------
    def ingest(self, path: str, dataset_name: str, fmt: str = "csv", kind: str | None = None, urgency: str = "reference",
               derive_outbreak: str = "reference", keep_raw: bool = True, retrain: bool = True, strict: bool = False,
               multiline: bool = True, max_gap_days: int | None = span.MAX_GAP_DAYS) -> DataFrame:
        """Read and normalise a dataset, train on it, and install both. Returns the dataset status.

        A CSV record with more fields than the header refuses the file; a record without a readable time is
        set aside with the reason, see ``rejected``. Encounters dated more than ``max_gap_days`` away from the bulk of their facility's
        don't stretch its series, see ``issues``. Facilities with too few hours stay in the fact and are left out of training, unless
        ``strict`` refuses them. What fails leaves the dataset and the models that were there.
        """
        quality.check_dataset_name(dataset_name)
        raw = read_raw(self.spark, path, fmt, multiline, with_file=True)
        kind = sniff_kind(raw.columns, kind)
        now = clock()
        stamp = "".join(c for c in now if c.isdigit())
        if keep_raw:
            sinks.write_raw(raw, f"{self.root}/raw/{kind}", stamp)
            raw = self.spark.read.parquet(f"{self.root}/raw/{kind}/_ingest_id={stamp}")
        wide = too_many_fields(raw).first()
        if wide is not None:
            raise ValueError(f"A record has more fields than the header: {wide.record[:200]}")
        # Times are read once; the default stays and the hours then read pruned columns of typed rows.
        staged = f"{self.root}/staged/{stamp}"
        counted = write_staged(stage_rows(raw, kind), staged)
        rows = accepted(self.spark, staged)
        if kind == "event":
            fact, source_type = hourly_from_encounters(rows, urgency, max_gap_days), "event_level_his"
        else:
            fact, source_type = hourly_from_readings(rows, derive_outbreak), "aggregate_his"
        target = f"{self.root}/hourly/{stamp}"
        sinks.write_hourly(fact, target)
        written = load_hourly(self.spark, target)
        long_enough = quality.trainable(written, strict=strict)
        models = train_all(long_enough, now, **self.learner) if retrain and self.method == "gbt" else None
        self._set({"hourly_path": target, "staged_path": staged, "source_name": dataset_name, "source_type": source_type, "rejected_rows": str(counted["rejected"])}, now)
        self.models = models
        seeds = state.default_thresholds(facilities_of(written), self._state("thresholds"), self.user, now)
        self._append(seeds, "thresholds")
        return self.dataset_status()

    def rejected(self) -> DataFrame:
        """The refused records of the installed dataset: file, reason, and the record as delivered."""
        path = state.get_setting(self._state("settings"), "staged_path")
        if path is None:
            raise ValueError("No dataset has been ingested.")
        return quarantine(self.spark, path)

    def issues(self) -> DataFrame:
        """(facility_id, rows, issue): facilities of the installed dataset that are too short to train on, and encounters dated so far away
        that they don't count."""
        short = quality.short_series(self.hourly())
        settings = self._state("settings")
        if state.get_setting(settings, "source_type") != "event_level_his":
            return short
        rows = accepted(self.spark, state.get_setting(settings, "staged_path"))
        return short.unionByName(span.span_issues(rows, materialise(span.main_spans(rows))).select("facility_id", "rows", "issue"))

    def ingest_text(self, csv_text: str, dataset_name: str, **options) -> DataFrame:
        """Ingest the CSV text of one request; files go through ``ingest``."""
        path = scratch_path(self.spark, "request")
        self.spark.createDataFrame([(quality.check_csv_text(csv_text),)], "value string").coalesce(1).write.text(path)
        return self.ingest(path, dataset_name, **options)

    def retrain(self) -> DataFrame:
        """Fit all models on the installed dataset; metadata is recomputed from the data."""
        self.models = train_all(quality.trainable(self.hourly()), clock(), **self.learner)
        return self.dataset_status()

    def _models(self) -> ForecastModels:
        if self.models is None:
            self.retrain()
        return self.models

    def dataset_status(self) -> DataFrame:
        settings = self._state("settings")
        metadata = dataset_metadata(
            self.hourly(), state.get_setting(settings, "source_name", ""), state.get_setting(settings, "source_type", "")
        ).withColumns({
            "trained_at": F.lit(self.models.trained_at if self.models else None).cast("string"),
            "rejected_rows": F.lit(state.get_setting(settings, "rejected_rows")).cast("bigint"),
        })
        if self.models is None:
            return metadata
        errors = model_metrics(self.models).groupBy("facility_id").agg(
            F.map_from_entries(F.collect_list(F.struct("department", F.struct("rmse", "capacity")))).alias("model_metrics")
        )
        return metadata.join(errors, "facility_id", "left")

    # --- look ---------------------------------------------------------------------------------
    def overview(self, as_of: str | None = None) -> dict[str, DataFrame]:
        fact = self.hourly(as_of)
        return {
            "hospital": kpis.overview_hospital(fact),
            "departments": kpis.overview_departments(fact),
            "analytics": kpis.overview_analytics(fact),
        }

    def trends(self, history_hours: int = C.HISTORY_DEFAULT) -> dict[str, DataFrame]:
        fact = self.hourly()
        history = trends.occupancy_history(fact, quality.check_history(history_hours))
        return {"occupancy_history": history, "daily_flow": trends.daily_flow(fact)}

    # --- forecast -----------------------------------------------------------------------------
    def _points(self, fact: DataFrame, scenarios: DataFrame, horizon: int | None) -> DataFrame:
        if self.method == "profile":
            return FC.profile_forecast(fact, scenarios, horizon)
        return gbt_forecast(fact, self._models(), scenarios, horizon)

    def forecast(self, horizon_hours: int = C.HORIZON_DEFAULT, department: str | None = None, as_of: str | None = None) -> DataFrame:
        """Baseline forecast points of all departments, or of one, from the end of the series or from ``as_of``."""
        fact = self.hourly(as_of)
        points = self._points(fact, baseline(facilities_of(fact)), quality.check_horizon(horizon_hours))
        return points if department is None else points.where(F.col("department") == quality.check_department(department))

    def alerts(self, horizon_hours: int = C.HORIZON_DEFAULT, threshold: float | None = None, persist: bool = True,
               as_of: str | None = None) -> DataFrame:
        """Baseline alerts; with ``persist`` they are merged into the history."""
        quality.check_threshold(threshold)
        points = self.forecast(horizon_hours, as_of=as_of)
        found = materialise(A.compute_alerts(points, self._state("thresholds"), threshold))
        if persist:
            self.record_alerts(found)
        return found.orderBy("facility_id", "position")

    def record_alerts(self, alerts: DataFrame) -> None:
        self._append(state.alert_changes(self._state("alert_history"), state.alert_rows(alerts, clock())), "alert_history")

    def alert_history(self, limit: int = C.ALERT_LIMIT_DEFAULT, facility_id: str | None = None) -> DataFrame:
        """The latest alerts of each facility, or of one."""
        return state.alert_history(self._state("alert_history"), limit, facility_id)

    def dashboard(self, horizon_hours: int = C.HORIZON_DEFAULT) -> dict[str, object]:
        """Everything one screen shows. The points are computed once and shared."""
        points = materialise(self.forecast(horizon_hours))
        thresholds = self._state("thresholds")
        found = materialise(A.compute_alerts(points, thresholds))
        self.record_alerts(found)
        return {
            "overview": self.overview(),
            "forecasts": points,
            "summaries": FC.forecast_summary(points),
            "alerts": found.orderBy("facility_id", "position"),
            "trends": self.trends(),
            "thresholds": state.list_thresholds(thresholds),
            "dataset": self.dataset_status(),
        }

    # --- thresholds -----------------------------------------------------------------------------
    def thresholds(self) -> DataFrame:
        return state.list_thresholds(self._state("thresholds"))

    def update_thresholds(self, values: dict[str, float], facility_id: str | None = None) -> DataFrame:
        """Set thresholds by department for one facility or for all; nothing is written if any is invalid."""
        for department, value in values.items():
            quality.check_department(department)
            quality.check_threshold(value)
        capacity = capacities(self.hourly())
        targets = capacity.select("facility_id").distinct()
        if facility_id is not None:
            targets = targets.where(F.col("facility_id") == facility_id)
        listed = F.array(*[
            F.struct(F.lit(d).alias("department"), F.lit(float(v)).alias("utilization_threshold")) for d, v in values.items()
        ])
        updates = targets.select("facility_id", F.inline(listed)).withColumns(
            {"updated_by": F.lit(self.user), "updated_at": state.at(clock())}
        )
        self._append(updates, "thresholds")
        return self.thresholds()

    def apply_threshold_updates(self, updates: DataFrame) -> DataFrame:
        """Bulk updates with ``request_id``: a request is written whole or, if any part is invalid, not at
        all. Returns the violations."""
        capacity = materialise(capacities(self.hourly()))
        accepted = quality.accepted_updates(updates, capacity).drop("request_id")
        newest = F.struct("updated_at", "utilization_threshold", "updated_by")
        self._append(state.latest(accepted, state.THRESHOLD_KEY, newest), "thresholds")
        return quality.threshold_violations(updates, capacity)

    # --- scenarios --------------------------------------------------------------------------------
    def save_scenarios(self, payloads: DataFrame) -> DataFrame:
        """Insert (no id) or update (id) scenarios; columns ``facility_id, id`` and the scenario inputs."""
        broken = quality.scenario_violations(payloads).first()
        if broken is not None:
            raise ValueError(f"Invalid scenario field: {broken.violation}")
        if not state.repeated_scenarios(payloads).isEmpty():
            raise ValueError("A scenario is named more than once.")
        existing = self._state("scenarios")
        if not state.unknown_scenarios(existing, payloads).isEmpty():
            raise ValueError("Scenario could not be saved.")
        ids = state.last_ids(self.spark, self._state_root)
        self._append(materialise(state.scenario_changes(existing, payloads, self.user, clock(), ids)), "scenarios")
        return self.scenarios()

    def scenarios(self) -> DataFrame:
        return state.list_scenarios(self._state("scenarios"))

    def scenario(self, facility_id: str, scenario_id: int) -> DataFrame:
        return state.get_scenario(self._state("scenarios"), facility_id, scenario_id)

    def delete_scenarios(self, keys: DataFrame) -> None:
        gone = self._state("scenarios").join(keys, state.SCENARIO_KEY, "left_semi")
        self._append(materialise(gone), "scenarios", deleted=True)

    def simulate(self, keys: DataFrame, horizon_hours: int | None = None) -> dict[str, DataFrame]:
        """Run saved scenarios, all in one job, each for the horizon given or its own duration.

        The alerts found are returned and not written to the history; the summaries are stored.
        """
        quality.check_horizon(horizon_hours)
        stored = self._state("scenarios")
        chosen = materialise(stored.join(keys, state.SCENARIO_KEY, "left_semi").withColumnRenamed("id", "scenario_id"))
        if chosen.isEmpty():
            raise ValueError("Scenario not found.")
        points = materialise(self._points(self.hourly(), chosen.select(*SCENARIO_COLUMNS), horizon_hours))
        summary = FC.scenario_summary(points)
        now = clock()
        self._append(state.last_run_changes(stored, state.run_summaries(summary, now), now), "scenarios")
        return {
            "scenarios": chosen,
            "forecasts": points,
            "alerts": A.compute_alerts(points, self._state("thresholds")).orderBy("facility_id", "scenario_id", "position"),
            "summary": summary,
        }
