"""State tables: thresholds, scenarios, alert history, settings.

Each table is a log of rows; the newest row of a key is its state. Writing is appending, so a reader never
sees a half-replaced table, and a batch that is written twice leaves the same state. Every write has the next
sequence number of its log, which decides between equal times; a log has one writer at a time. ``compact`` replaces what
was written so far by one row a key, so that reading costs the keys and what was written since. Every function
takes ``now`` instead of reading a clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bedtide import config as C
from bedtide.operators.quality import check_limit

THRESHOLD_KEY = ["facility_id", "department"]
ALERT_KEY = ["facility_id", "department", "forecast_timestamp", "threshold"]
SCENARIO_KEY = ["facility_id", "id"]

SCHEMAS = {
    "thresholds": "facility_id string, department string, utilization_threshold double, updated_by string, "
                  "updated_at timestamp",
    "alert_history": "id bigint, facility_id string, department string, label string, forecast_timestamp string, "
                     "utilization double, threshold double, severity string, message string, created_at timestamp",
    "scenarios": "id bigint, facility_id string, name string, description string, admissions_multiplier double, "
                 "discharges_multiplier double, emergency_multiplier double, outbreak_delta double, "
                 "occupancy_delta double, duration_hours int, created_by string, created_at timestamp, "
                 "updated_at timestamp, last_run_at timestamp, last_run_summary string",
    "settings": "key string, value string, updated_at timestamp",
}
KEYS = {"thresholds": THRESHOLD_KEY, "alert_history": ALERT_KEY, "scenarios": SCENARIO_KEY, "settings": ["key"]}


def at(now: str | Column) -> Column:
    return F.lit(now).cast("timestamp") if isinstance(now, str) else now


def latest(log: DataFrame, key: list[str], newest: Column) -> DataFrame:
    """The newest row per key. A plain aggregate: rows of a key meet pre-reduced, hot keys included."""
    rest = [c for c in log.columns if c not in key]
    return log.groupBy(*key).agg(F.max_by(F.struct(*rest), newest).alias("row")).select(
        *[F.col(c) if c in key else F.col(f"row.{c}").alias(c) for c in log.columns]
    )


def apply_changes(existing: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """The state after ``changes``, which hold at most one row per key.

    Both sides read ``existing``, so store the state between two merges rather than chaining them.
    """
    return existing.join(changes, key, "left_anti").unionByName(changes)


# --- thresholds -----------------------------------------------------------------------------------
def default_thresholds(facilities: DataFrame, existing: DataFrame | None, by: str, now: str | Column) -> DataFrame:
    """Rows to insert: 0.9 for every department of a facility that has no threshold yet."""
    wanted = facilities.select("facility_id", F.explode(F.array(*[F.lit(d) for d in C.DEPARTMENTS])).alias("department"))
    if existing is not None:
        wanted = wanted.join(existing, THRESHOLD_KEY, "left_anti")
    return wanted.withColumns({
        "utilization_threshold": F.lit(C.THRESHOLD_DEFAULT), "updated_by": F.lit(by), "updated_at": at(now),
    })


def merge_thresholds(existing: DataFrame, updates: DataFrame, newest: Column | None = None) -> DataFrame:
    """Upsert by facility and department, last one wins; equal times go to the update."""
    order = F.col("updated_at") if newest is None else newest
    log = existing.withColumn("_from", F.lit(0)).unionByName(updates.withColumn("_from", F.lit(1)))
    return latest(log, THRESHOLD_KEY, F.struct(order, "_from", "utilization_threshold", "updated_by")).drop("_from")


def list_thresholds(thresholds: DataFrame) -> DataFrame:
    return thresholds.select(*THRESHOLD_KEY, "utilization_threshold").orderBy(*THRESHOLD_KEY)


# --- alert history ----------------------------------------------------------------------------------
def alert_rows(alerts: DataFrame, now: str | Column) -> DataFrame:
    """Alerts of the baseline as history rows; what-if alerts never reach the history."""
    return alerts.where(F.col("scenario_id") == C.BASELINE_SCENARIO).select(
        "facility_id", "department", "label", F.col("timestamp").alias("forecast_timestamp"),
        "utilization", "threshold", "severity", "message", at(now).alias("created_at"),
    )


def next_ids(existing: DataFrame, new: DataFrame, order: list[Column], last_ids: DataFrame | None = None) -> DataFrame:
    """Number new rows of each facility after the highest id it has, or ever had (``last_ids``).

    A facility's new rows are a handful per run (alerts, saved scenarios), so the numbering is per facility.
    """
    used = existing.select("facility_id", "id")
    if last_ids is not None:
        used = used.unionByName(last_ids.select("facility_id", F.col("last_id").alias("id")))
    highest = used.groupBy("facility_id").agg(F.max("id").alias("highest"))
    position = F.row_number().over(Window.partitionBy("facility_id").orderBy(*order))
    return new.withColumn("position", position).join(highest, "facility_id", "left").withColumn(
        "id", (F.coalesce("highest", F.lit(0)) + F.col("position")).cast("bigint")
    ).drop("position", "highest")


def alert_changes(existing: DataFrame, alerts: DataFrame) -> DataFrame:
    """The history rows that alerts lead to, one per key.

    A known alert keeps its id and label and takes the new utilization, severity, message and time; a new
    one gets the next id of its facility.
    """
    fresh = latest(alerts, ALERT_KEY, F.struct("created_at", "utilization"))
    matched = fresh.join(existing.select(*ALERT_KEY, "id", F.col("label").alias("known_label")), ALERT_KEY, "left")
    known = matched.where("id IS NOT NULL").withColumn("label", F.col("known_label")).drop("known_label")
    order = [F.col("created_at"), F.desc("utilization"), *[F.col(c) for c in ALERT_KEY]]
    added = next_ids(existing, matched.where("id IS NULL").drop("id", "known_label"), order)
    return known.unionByName(added).select(*existing.columns)


def merge_alerts(existing: DataFrame, alerts: DataFrame) -> DataFrame:
    """Upsert by facility, department, forecast time and threshold."""
    return apply_changes(existing, alert_changes(existing, alerts), ALERT_KEY)


def alert_history(history: DataFrame, limit: int = C.ALERT_LIMIT_DEFAULT, facility_id: str | None = None) -> DataFrame:
    """The ``limit`` alerts of each facility, or of one, with the latest forecast time, as ``position`` 1, 2, ..."""
    check_limit(limit)
    if facility_id is not None:
        history = history.where(F.col("facility_id") == facility_id)
    order = Window.partitionBy("facility_id").orderBy(F.desc("forecast_timestamp"), F.desc("id"))
    return history.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit).orderBy("facility_id", "position")


# --- scenarios -----------------------------------------------------------------------------------------
SCENARIO_INPUT = ["name", "description", *C.SCENARIO_BOUNDS]


def unknown_scenarios(existing: DataFrame, payloads: DataFrame) -> DataFrame:
    """Payloads that name an id their facility does not have."""
    return payloads.where(F.col("id").isNotNull()).join(existing, SCENARIO_KEY, "left_anti")


def repeated_scenarios(payloads: DataFrame) -> DataFrame:
    """Keys that payloads name more than once: which of them should count is not defined."""
    return payloads.where(F.col("id").isNotNull()).groupBy(*SCENARIO_KEY).count().where("count > 1").select(*SCENARIO_KEY)


def scenario_changes(existing: DataFrame, payloads: DataFrame, by: str, now: str | Column, last_ids: DataFrame | None = None) -> DataFrame:
    """The scenario rows that payloads lead to.

    A payload with an id updates that scenario, which keeps its maker, its creation time and its last run;
    one without is inserted; one with an unknown id changes nothing, see ``unknown_scenarios``.
    """
    kept = existing.select(*SCENARIO_KEY, "created_by", "created_at", "last_run_at", "last_run_summary")
    updated = payloads.where(F.col("id").isNotNull()).join(kept, SCENARIO_KEY).withColumn("updated_at", at(now))
    order = [F.col(c) for c in SCENARIO_INPUT]
    inserted = next_ids(existing, payloads.where(F.col("id").isNull()).drop("id"), order, last_ids).withColumns({
        "created_by": F.lit(by), "created_at": at(now), "updated_at": at(now),
        "last_run_at": F.lit(None).cast("timestamp"), "last_run_summary": F.lit(None).cast("string"),
    })
    return updated.select(*existing.columns).unionByName(inserted.select(*existing.columns))


def merge_scenarios(existing: DataFrame, payloads: DataFrame, by: str, now: str | Column, last_ids: DataFrame | None = None) -> DataFrame:
    return apply_changes(existing, scenario_changes(existing, payloads, by, now, last_ids), SCENARIO_KEY)


def delete_scenarios(existing: DataFrame, keys: DataFrame) -> DataFrame:
    """Without the named scenarios; an absent one is no error."""
    return existing.join(keys, SCENARIO_KEY, "left_anti")


def list_scenarios(scenarios: DataFrame) -> DataFrame:
    """Last changed first."""
    return scenarios.orderBy(F.desc("updated_at"), F.desc("id"), "facility_id")


def decoded(scenarios: DataFrame) -> DataFrame:
    """``scenarios`` with their last summaries decoded."""
    summary = "struct<generated_at:string,summary:array<struct<department:string,label:string," \
              "peak_occupancy:double,peak_timestamp:string,capacity:int>>>"
    return scenarios.withColumn("last_run_summary", F.from_json("last_run_summary", summary))


def get_scenario(scenarios: DataFrame, facility_id: str, scenario_id: int) -> DataFrame:
    """One scenario with its last summary decoded."""
    return decoded(scenarios.where((F.col("facility_id") == facility_id) & (F.col("id") == scenario_id)))


def run_summaries(summary: DataFrame, now: str) -> DataFrame:
    """(facility_id, id, last_run_summary) from a scenario summary; four entries a scenario."""
    entry = F.struct("department", "label", "peak_occupancy", "peak_timestamp", "capacity")
    listed = summary.groupBy("facility_id", F.col("scenario_id").alias("id")).agg(F.sort_array(F.collect_list(entry)).alias("summary"))
    return listed.select(*SCENARIO_KEY, F.to_json(F.struct(F.lit(now).alias("generated_at"), "summary")).alias("summary_json"))


def last_run_changes(existing: DataFrame, summaries: DataFrame, now: str | Column) -> DataFrame:
    return existing.join(summaries, SCENARIO_KEY).withColumns({
        "last_run_at": at(now), "updated_at": at(now), "last_run_summary": F.col("summary_json"),
    }).select(*existing.columns)


def record_last_run(existing: DataFrame, summaries: DataFrame, now: str | Column) -> DataFrame:
    """Store when scenarios last ran and what came out."""
    return apply_changes(existing, last_run_changes(existing, summaries, now), SCENARIO_KEY)


# --- settings ------------------------------------------------------------------------------------------
def merge_settings(existing: DataFrame, updates: DataFrame) -> DataFrame:
    log = existing.withColumn("_from", F.lit(0)).unionByName(updates.withColumn("_from", F.lit(1)))
    return latest(log, ["key"], F.struct("updated_at", "_from", "value")).drop("_from")


def get_setting(settings: DataFrame, key: str, default: str | None = None) -> str | None:
    row = settings.where(F.col("key") == key).select("value").first()
    return default if row is None else row.value


def latest_metadata(history: DataFrame) -> DataFrame:
    """The last recorded metadata of each facility, from an append-only history."""
    return latest(history, ["facility_id"], F.struct("recorded_at", "source_name"))


# --- storage -------------------------------------------------------------------------------------------
LOG_COLUMNS = "deleted boolean, logged_at timestamp, sequence bigint"


POINTER = "generation bigint, sequence bigint"


def _place(root: str, name: str, part: str) -> str:
    return f"{root.rstrip('/')}/{name}/{part}"


def _log_schema(name: str) -> str:
    return f"{SCHEMAS[name]}, {LOG_COLUMNS}"


def create_log(spark: SparkSession, root: str, name: str) -> None:
    """An empty log: its pointers, and the first tail that writes go to."""
    spark.createDataFrame([], POINTER).write.mode("ignore").parquet(_place(root, name, "pointers"))
    spark.createDataFrame([], _log_schema(name)).write.mode("ignore").parquet(_place(root, name, "tail-0"))


def pointer(spark: SparkSession, root: str, name: str) -> tuple[int, int]:
    """(generation, last sequence number in its snapshot) of the log's newest snapshot; (0, 0) before the first."""
    newest = spark.read.schema(POINTER).parquet(_place(root, name, "pointers")).agg(F.max(F.struct("generation", "sequence")).alias("p")).first().p
    return (newest.generation, newest.sequence) if newest else (0, 0)


def read_tail(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The rows written since the newest snapshot."""
    return spark.read.schema(_log_schema(name)).parquet(_place(root, name, f"tail-{pointer(spark, root, name)[0]}"))


def read_log(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The newest snapshot, which holds one row for each key ever written, and the tail; earlier files are not read."""
    generation, _ = pointer(spark, root, name)
    parts = [f"tail-{generation}"] + ([f"snapshot-{generation}"] if generation else [])
    return spark.read.schema(_log_schema(name)).parquet(*(_place(root, name, part) for part in parts))


def _newest_rows(spark: SparkSession, root: str, name: str) -> DataFrame:
    return latest(read_log(spark, root, name), KEYS[name], F.struct("logged_at", "sequence"))


def read_state(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The newest row of every key that was not deleted."""
    return _newest_rows(spark, root, name).where("NOT deleted").drop("deleted", "logged_at", "sequence")


def next_sequence(spark: SparkSession, root: str, name: str) -> int:
    last = read_tail(spark, root, name).agg(F.max("sequence")).first()[0]
    return max(last or 0, pointer(spark, root, name)[1]) + 1


def append_log(rows: DataFrame, root: str, name: str, logged_at: str, deleted: bool = False) -> None:
    spark = rows.sparkSession
    stamped = rows.withColumns({"deleted": F.lit(deleted), "logged_at": at(logged_at), "sequence": F.lit(next_sequence(spark, root, name))})
    target = spark.createDataFrame([], _log_schema(name)).schema
    columns = [F.col(f.name).cast(f.dataType) for f in target]
    stamped.select(*columns).write.mode("append").parquet(_place(root, name, f"tail-{pointer(spark, root, name)[0]}"))


def compact(spark: SparkSession, root: str, name: str) -> int:
    """Write the newest row of every key, deleted ones included, as a snapshot and begin a new tail; its generation.

    The pointer is written last: a reader sees the old snapshot and tail or the new ones, and what a broken attempt left is
    overwritten by the next. Earlier files stay for readers that began with them. A log has one writer at a time.
    """
    generation, sequence = pointer(spark, root, name)[0] + 1, next_sequence(spark, root, name) - 1
    _newest_rows(spark, root, name).write.mode("overwrite").parquet(_place(root, name, f"snapshot-{generation}"))
    spark.createDataFrame([], _log_schema(name)).write.mode("overwrite").parquet(_place(root, name, f"tail-{generation}"))
    spark.createDataFrame([(generation, sequence)], POINTER).coalesce(1).write.mode("append").parquet(_place(root, name, "pointers"))
    return generation


def last_ids(spark: SparkSession, root: str) -> DataFrame:
    """The highest scenario id each facility ever had, deleted ones included: ids are not given out twice."""
    return read_log(spark, root, "scenarios").groupBy("facility_id").agg(F.max("id").alias("last_id"))
