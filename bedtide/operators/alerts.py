"""Threshold alerts from forecast points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bedtide import config as C
from bedtide.functions import scalar as S
from bedtide.operators.forecast import SERIES


def with_thresholds(points: DataFrame, thresholds: DataFrame | None, override: float | None = None) -> DataFrame:
    """The stored threshold of each department, 0.9 where none is stored, or one value for all."""
    if override is not None or thresholds is None:
        value = C.THRESHOLD_DEFAULT if override is None else override
        return points.withColumn("threshold", F.lit(float(value)))
    stored = thresholds.select("facility_id", "department", F.col("utilization_threshold").alias("threshold"))
    return points.join(stored, ["facility_id", "department"], "left").withColumn(
        "threshold", F.coalesce("threshold", F.lit(C.THRESHOLD_DEFAULT))
    )


def compute_alerts(points: DataFrame, thresholds: DataFrame | None = None, override: float | None = None) -> DataFrame:
    """The first point of each series at or over its threshold, compared after rounding, most utilized first.

    ``position`` is the rank within facility and scenario; equal utilization keeps department order.
    """
    breaches = with_thresholds(points, thresholds, override).where(F.col("utilization") >= F.col("threshold"))
    first = breaches.groupBy(*SERIES).agg(
        F.min_by(F.struct("timestamp", "utilization", "threshold"), "step").alias("hit")
    )
    label = S.label_of(F.col("department"))
    utilization, threshold = F.col("hit.utilization"), F.col("hit.threshold")
    rank = Window.partitionBy("facility_id", "scenario_id").orderBy(
        F.desc("utilization"), S.department_order(F.col("department"))
    )
    return first.select(
        *SERIES, label.alias("label"),
        F.col("hit.timestamp").alias("timestamp"),
        utilization.alias("utilization"),
        S.round_binary(threshold, 3).alias("threshold"),
        S.severity_of(utilization, threshold).alias("severity"),
        S.alert_message(label, utilization, threshold).alias("message"),
    ).withColumn("position", F.row_number().over(rank))
