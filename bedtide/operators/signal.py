"""Outbreak signal: how far admissions and emergencies stand above their week, scaled to 0..1 per facility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A week of hours, a day of hours before rolling figures count, the two weights.
WEEK, MIN_PERIODS = 168, 24
WEIGHTS = {"admissions": 0.7, "emergency_cases": 0.3}


def _excess(column: str) -> Column:
    """Standard score over the last 168 rows, this one included, floored at 0.

    Under 24 rows the mean is the one of all rows so far and the deviation the one of the whole series,
    which also stands in for a rolling deviation of 0; a deviation of 0 or unknown counts as 1.
    """
    order = Window.partitionBy("facility_id").orderBy("ts")
    week, so_far = order.rowsBetween(1 - WEEK, 0), order.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("facility_id")
    enough = F.count(column).over(week) >= MIN_PERIODS
    baseline = F.coalesce(F.when(enough, F.avg(column).over(week)), F.avg(column).over(so_far))
    overall = F.coalesce(F.nullif(F.stddev_samp(column).over(whole), F.lit(0.0)), F.lit(1.0))
    rolling = F.nullif(F.when(enough, F.stddev_samp(column).over(week)), F.lit(0.0))
    return F.greatest(F.lit(0.0), (F.col(column) - baseline) / F.coalesce(rolling, overall))


def with_outbreak_signal(hourly: DataFrame) -> DataFrame:
    """Add ``outbreak_signal``. All windows share one exchange on facility_id."""
    combined = sum((F.lit(w) * _excess(c) for c, w in WEIGHTS.items()), F.lit(0.0))
    top = F.max("combined").over(Window.partitionBy("facility_id"))
    scaled = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col("combined") / F.greatest(top, F.lit(1.0)), F.lit(0.0))))
    return hourly.withColumn("combined", combined).withColumn("outbreak_signal", scaled).drop("combined")
