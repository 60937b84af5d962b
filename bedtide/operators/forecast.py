"""Forecast points and what is read from them; the profile forecaster, which needs no model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bedtide import config as C
from bedtide.functions import scalar as S
from bedtide.operators.capacity import capacities
from bedtide.operators.features import time_split
from bedtide.operators.hourly import by_department
from bedtide.operators.profile import dense_profile
from bedtide.operators.scenarios import projected_hours, with_scenarios

SERIES = ["facility_id", "scenario_id", "department"]


def prediction_band(values: DataFrame) -> DataFrame:
    """Predicted value, capacity and rmse to presented points: clamped to the beds there are, a band of
    1.96 rmse on either side, one decimal, utilization at three."""
    value = S.clamp(F.col("predicted"), F.lit(0.0), F.col("capacity").cast("double"))
    margin = F.lit(C.BAND_Z) * F.col("rmse")
    return values.withColumn("value", value).select(
        *SERIES, "step", S.iso(F.col("ts")).alias("timestamp"), "capacity",
        S.round_binary(F.col("value"), 1).alias("occupied"),
        S.round_binary(F.greatest(F.lit(0.0), F.col("value") - margin), 1).alias("lower"),
        S.round_binary(F.least(F.col("capacity").cast("double"), F.col("value") + margin), 1).alias("upper"),
        S.round_binary(S.utilization(F.col("value"), F.col("capacity")), 3).alias("utilization"),
    )


def profile_errors(hourly: DataFrame) -> DataFrame:
    """(facility_id, department, rmse): a profile of the first 85 % of rows scored on the rest, at least 1.5."""
    split = time_split(hourly, ("facility_id",))
    fitted = dense_profile(split.where("is_train"), C.OCCUPANCY_COLUMNS)
    scored = split.where("NOT is_train").select(
        "facility_id", F.weekday("ts").alias("dow"), F.hour("ts").alias("hour"),
        *[F.col(c).alias(f"actual_{c}") for c in C.OCCUPANCY_COLUMNS],
    )
    errors = scored.join(fitted, ["facility_id", "dow", "hour"]).groupBy("facility_id").agg(*[
        F.sqrt(F.avg((F.col(f"actual_{d}_occupied") - F.col(f"{d}_occupied")) * (F.col(f"actual_{d}_occupied") - F.col(f"{d}_occupied")))).alias(d)
        for d in C.DEPARTMENTS
    ])
    pairs = ", ".join(f"'{d}', {d}" for d in C.DEPARTMENTS)
    return errors.select("facility_id", F.expr(f"stack({len(C.DEPARTMENTS)}, {pairs}) AS (department, error)")).select(
        "facility_id", "department", F.greatest(F.lit(C.RMSE_FLOOR), F.col("error")).alias("rmse")
    )


def profile_forecast(hourly: DataFrame, scenarios: DataFrame, horizon: int | None = C.HORIZON_DEFAULT) -> DataFrame:
    """Mean occupancy of the weekday-hour plus the scenario's bed change while it lasts."""
    reach = C.HORIZON_MAX if horizon is None else horizon
    rows = with_scenarios(projected_hours(hourly, reach, C.OCCUPANCY_COLUMNS), scenarios, horizon)
    long = by_department(rows, "scenario_id", "step", "active", "occupancy_delta")
    shift = F.when(F.col("active"), F.col("occupancy_delta")).otherwise(F.lit(0.0))
    values = (
        long.withColumn("predicted", F.col("occupied") + shift)
        .join(capacities(hourly), ["facility_id", "department"])
        .join(profile_errors(hourly), ["facility_id", "department"], "left")
        .withColumn("rmse", F.coalesce("rmse", F.lit(C.RMSE_FLOOR)))
    )
    return prediction_band(values)


def forecast_summary(points: DataFrame) -> DataFrame:
    """Per series: its length, the first highest point, and that point again if it reaches 90 %."""
    peak = F.max_by(F.struct("timestamp", "occupied", "lower", "upper", "utilization"), F.struct(F.col("occupied"), -F.col("step")))
    found = points.groupBy(*SERIES).agg(
        F.max("capacity").alias("capacity"), F.count(F.lit(1)).alias("horizon_hours"), peak.alias("peak")
    )
    crossing = F.col("peak.utilization") >= F.lit(C.THRESHOLD_DEFAULT)
    return found.select(
        *SERIES, S.label_of(F.col("department")).alias("label"), "capacity", "horizon_hours",
        F.col("peak.occupied").alias("peak_occupancy"),
        F.col("peak.timestamp").alias("peak_timestamp"),
        F.when(crossing, F.col("peak.timestamp")).alias("crossing_timestamp"),
        F.when(crossing, F.col("peak.utilization")).alias("crossing_utilization"),
        *(F.when(crossing, F.col(f"peak.{c}")).alias(f"crossing_{c}") for c in ("occupied", "lower", "upper")),
    )


def scenario_summary(points: DataFrame) -> DataFrame:
    return forecast_summary(points).select(*SERIES, "label", "peak_occupancy", "peak_timestamp", "capacity")


def nested_forecasts(points: DataFrame) -> DataFrame:
    """Presentation form: one row per series with its points (168 at most) as an array in time order."""
    point = F.struct("step", "timestamp", "occupied", "lower", "upper", "utilization")
    listed = points.groupBy(*SERIES).agg(F.sort_array(F.collect_list(point)).alias("points"))
    return forecast_summary(points).join(listed, SERIES)
