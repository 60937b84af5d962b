"""Argument checks and data rules. Rules on rows return tables of violations; checks on arguments raise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bedtide import config as C


# --- arguments ----------------------------------------------------------------------------------
def clamp_horizon(hours: int) -> int:
    return max(C.HORIZON_MIN, min(int(hours), C.HORIZON_MAX))


def clamp_history(hours: int) -> int:
    return max(C.HISTORY_MIN, min(int(hours), C.HISTORY_MAX))


def _within(name: str, value, low, high):
    if value is not None and not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}, got {value}")
    return value


def check_horizon(hours: int | None) -> int | None:
    return _within("horizon_hours", hours, C.HORIZON_MIN, C.HORIZON_MAX)


def check_history(hours: int) -> int:
    return _within("history_hours", hours, C.HISTORY_MIN, C.HISTORY_MAX)


def check_limit(limit: int) -> int:
    return _within("limit", limit, C.ALERT_LIMIT_MIN, C.ALERT_LIMIT_MAX)


def check_threshold(threshold: float | None) -> float | None:
    return _within("threshold", threshold, C.THRESHOLD_MIN, C.THRESHOLD_MAX)


def check_department(department: str) -> str:
    if department not in C.DEPARTMENTS:
        raise ValueError(f"Unknown department: {department}")
    return department


def check_dataset_name(name: str) -> str:
    low, high = C.DATASET_NAME_LENGTH
    if not low <= len(name) <= high:
        raise ValueError(f"dataset_name must have {low} to {high} characters")
    return name


def check_csv_text(text: str) -> str:
    if len(text) < C.CSV_TEXT_MIN_LENGTH:
        raise ValueError(f"csv_text must have at least {C.CSV_TEXT_MIN_LENGTH} characters")
    return text


# --- series ---------------------------------------------------------------------------------------
def series_lengths(hourly: DataFrame, minimum: int = C.MIN_SERIES_ROWS) -> DataFrame:
    """(facility_id, rows, is_short): whether a facility's hourly series is long enough to train on."""
    counted = hourly.groupBy("facility_id").agg(F.count(F.lit(1)).alias("rows"))
    return counted.withColumn("is_short", F.col("rows") < minimum)


def short_series(hourly: DataFrame, minimum: int = C.MIN_SERIES_ROWS) -> DataFrame:
    """Facilities that are too short, with the issue spelt out."""
    message = f"Dataset must contain at least {minimum} hourly rows after preprocessing."
    return series_lengths(hourly, minimum).where("is_short").select("facility_id", "rows", F.lit(message).alias("issue"))


def trainable(hourly: DataFrame, minimum: int = C.MIN_SERIES_ROWS, strict: bool = False) -> DataFrame:
    """The hours of the facilities that are long enough to train on, ``short_series`` names the others. Raises when
    there is none, and with ``strict`` when there is any other."""
    counted = series_lengths(hourly, minimum).agg(F.count(F.when(~F.col("is_short"), 1)).alias("long"), F.count(F.when(F.col("is_short"), 1)).alias("short")).first()
    if not counted.long or strict and counted.short:
        raise ValueError(f"Too few hours to train on: {minimum} are needed for each facility.")
    return hourly if not counted.short else hourly.join(series_lengths(hourly, minimum).where("NOT is_short").select("facility_id"), "facility_id", "left_semi")


def require_min_rows(hourly: DataFrame, minimum: int = C.MIN_SERIES_ROWS) -> DataFrame:
    """Raise when any facility is too short or when there is no facility at all."""
    seen = hourly.groupBy("facility_id").agg(F.count(F.lit(1)).alias("rows")).agg(F.min("rows").alias("fewest")).first()
    if seen.fewest is None or seen.fewest < minimum:
        raise ValueError(f"Dataset must contain at least {minimum} hourly rows after preprocessing.")
    return hourly


# --- thresholds -------------------------------------------------------------------------------------
def threshold_violations(updates: DataFrame, capacity: DataFrame) -> DataFrame:
    """Updates naming a department the facility does not have, or outside 0.5 to 1.0."""
    known = capacity.select("facility_id", "department").withColumn("known", F.lit(True))
    value = F.col("utilization_threshold")
    rule = F.when(F.col("known").isNull(), F.concat(F.lit("Unknown department: "), F.col("department"))).when(
        value.isNull() | ~value.between(C.THRESHOLD_MIN, C.THRESHOLD_MAX),
        F.lit("Thresholds must be between 0.5 and 1.0."),
    )
    return (
        updates.join(known, ["facility_id", "department"], "left")
        .withColumn("violation", rule).drop("known").where(F.col("violation").isNotNull())
    )


def accepted_updates(updates: DataFrame, capacity: DataFrame) -> DataFrame:
    """All updates of the requests in which every update is valid; a request is written whole or not at all."""
    refused = threshold_violations(updates, capacity).select("request_id").distinct()
    return updates.join(refused, "request_id", "left_anti")


# --- scenarios -----------------------------------------------------------------------------------------
def scenario_violations(payloads: DataFrame) -> DataFrame:
    """One row per broken rule: the payload's columns plus ``violation``."""
    rules = [
        F.when(~F.coalesce(F.length("name").between(*C.SCENARIO_NAME_LENGTH), F.lit(False)), F.lit("name")),
        F.when(F.length("description") > C.SCENARIO_DESCRIPTION_MAX, F.lit("description")),
        *[
            F.when(~F.coalesce(F.col(c).between(low, high), F.lit(False)), F.lit(c))
            for c, (low, high) in C.SCENARIO_BOUNDS.items()
        ],
    ]
    return payloads.withColumn("violation", F.explode(F.array_compact(F.array(*rules))))


def valid_scenarios(payloads: DataFrame) -> DataFrame:
    """Payloads that break no rule."""
    ok = F.coalesce(F.length("name").between(*C.SCENARIO_NAME_LENGTH), F.lit(False)) & F.coalesce(
        F.length("description") <= C.SCENARIO_DESCRIPTION_MAX, F.lit(True)
    )
    for column, (low, high) in C.SCENARIO_BOUNDS.items():
        ok = ok & F.coalesce(F.col(column).between(low, high), F.lit(False))
    return payloads.where(ok)
