"""Capacities and dataset metadata, derived from the hourly fact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bedtide import config as C
from bedtide.functions import scalar as S


def _capacity_columns(peaks: str = "{}_peak", names: str = "{}_capacity") -> list:
    return [
        S.capacity_of(F.col(peaks.format(d)), C.DEFAULT_CAPACITIES[d]).alias(names.format(d)) for d in C.DEPARTMENTS
    ]


def wide_capacities(hourly: DataFrame) -> DataFrame:
    """(facility_id, icu_capacity, ward_capacity, ...); a department without a column has peak 0."""
    peak = lambda d: F.max(f"{d}_occupied") if f"{d}_occupied" in hourly.columns else F.lit(0.0)
    peaks = hourly.groupBy("facility_id").agg(*[peak(d).alias(f"{d}_peak") for d in C.DEPARTMENTS])
    return peaks.select("facility_id", *_capacity_columns())


def capacities(hourly: DataFrame) -> DataFrame:
    """(facility_id, department, capacity)."""
    pairs = ", ".join(f"'{d}', {d}_capacity" for d in C.DEPARTMENTS)
    return wide_capacities(hourly).select(
        "facility_id", F.expr(f"stack({len(C.DEPARTMENTS)}, {pairs}) AS (department, capacity)")
    )


def dataset_metadata(hourly: DataFrame, source_name: str, source_type: str) -> DataFrame:
    """One row per facility: source, row count, coverage and the four capacities, in one aggregate."""
    summary = hourly.groupBy("facility_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        *[F.max(f"{d}_occupied").alias(f"{d}_peak") for d in C.DEPARTMENTS],
    )
    return summary.select(
        "facility_id",
        F.lit(source_name).alias("source_name"),
        F.lit(source_type).alias("source_type"),
        "rows",
        S.iso(F.col("first_ts")).alias("coverage_start"),
        S.iso(F.col("last_ts")).alias("coverage_end"),
        *_capacity_columns(names="capacity_{}"),
    )


def capacity_lines(metadata: DataFrame) -> DataFrame:
    """Display string "icu: 50 | ward: 260 | ..." per facility."""
    parts = [F.concat(F.lit(f"{d}: "), F.col(f"capacity_{d}").cast("string")) for d in C.DEPARTMENTS]
    return metadata.select("facility_id", F.array_join(F.array(*parts), " | ").alias("capacity_line"))


def threshold_lines(capacity: DataFrame) -> DataFrame:
    """Reference level of each department's forecast chart."""
    return capacity.select("facility_id", "department", S.threshold_line(F.col("capacity")).alias("threshold_line"))
