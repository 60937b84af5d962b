"""Operating figures: latest state, change over a day, hospital totals, admission patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bedtide import config as C
from bedtide.functions import scalar as S
from bedtide.operators.capacity import _capacity_columns


def snapshot(hourly: DataFrame) -> DataFrame:
    """One row per facility with everything the overview needs, from one pass over the hourly fact.

    ``earlier`` is the 25th row from the end, or the first row of a shorter series.
    """
    newest_first = Window.partitionBy("facility_id").orderBy(F.desc("ts"))
    whole = Window.partitionBy("facility_id")
    numbered = hourly.withColumn("back", F.row_number().over(newest_first)).withColumn("n", F.count(F.lit(1)).over(whole))
    is_latest = F.col("back") == 1
    is_earlier = F.col("back") == F.least(F.lit(25), F.col("n"))
    return numbered.groupBy("facility_id").agg(
        *[F.max(F.when(is_latest, F.col(c))).alias(f"latest_{c}") for c in ["ts", "outbreak_signal", *C.OCCUPANCY_COLUMNS]],
        *[F.max(F.when(is_earlier, F.col(c))).alias(f"earlier_{c}") for c in C.OCCUPANCY_COLUMNS],
        *[F.max(f"{d}_occupied").alias(f"{d}_peak") for d in C.DEPARTMENTS],
        F.avg("ward_occupied").alias("mean_ward"),
        F.avg("discharges").alias("mean_discharges"),
        F.avg("total_occupied").alias("mean_total"),
        F.avg("admissions").alias("mean_admissions"),
    )


def _with_capacities(snap: DataFrame) -> DataFrame:
    return snap.select("*", *_capacity_columns())


def overview_departments(hourly: DataFrame) -> DataFrame:
    """Latest occupancy, free beds, utilization, 24-row change and status per department."""
    entries = ", ".join(
        f"'{d}', latest_{d}_occupied, earlier_{d}_occupied, {d}_capacity" for d in C.DEPARTMENTS
    )
    long = _with_capacities(snapshot(hourly)).select(
        "facility_id", F.expr(f"stack({len(C.DEPARTMENTS)}, {entries}) AS (department, occupied, earlier, capacity)")
    )
    occupied, capacity = F.col("occupied"), F.col("capacity")
    rounded = S.round_binary(S.utilization(occupied, capacity), 3)
    return long.select(
        "facility_id", "department",
        S.label_of(F.col("department")).alias("label"),
        "capacity",
        S.round_binary(occupied, 1).alias("occupied"),
        S.round_binary(capacity - occupied, 1).alias("available"),
        rounded.alias("utilization"),
        S.round_binary(occupied - F.col("earlier"), 1).alias("delta_24h"),
        S.status_flag(rounded).alias("is_critical"),
    )


def overview_hospital(hourly: DataFrame) -> DataFrame:
    """Capacity, occupied and free beds and utilization over all departments of a facility."""
    snap = _with_capacities(snapshot(hourly))
    occupied = sum((F.col(f"latest_{d}_occupied") for d in C.DEPARTMENTS), F.lit(0.0))
    total = sum((F.col(f"{d}_capacity") for d in C.DEPARTMENTS), F.lit(0))
    return snap.select("facility_id", total.alias("total_capacity"), occupied.alias("beds")).select(
        "facility_id", "total_capacity",
        S.round_binary(F.col("beds"), 1).alias("occupied"),
        S.round_binary(F.col("total_capacity") - F.col("beds"), 1).alias("available"),
        S.round_binary(S.utilization(F.col("beds"), F.col("total_capacity")), 3).alias("utilization"),
    )


def overview_rollup(hourly: DataFrame) -> DataFrame:
    """Capacity, occupied and free beds and utilization at three levels in one aggregate: department, facility, and the network
    of all facilities, each as it stands at its own last hour. A NULL key stands for all of its values."""
    entries = ", ".join(f"'{d}', latest_{d}_occupied, {d}_capacity" for d in C.DEPARTMENTS)
    long = _with_capacities(snapshot(hourly)).select("facility_id", F.expr(f"stack({len(C.DEPARTMENTS)}, {entries}) AS (department, beds, capacity)"))
    rolled = long.rollup("facility_id", "department").agg(
        F.grouping_id().alias("level"), F.sum("capacity").alias("capacity"), F.sum("beds").alias("beds"), F.count(F.lit(1)).alias("series"))
    level = F.when(F.col("level") == 0, "department").when(F.col("level") == 1, "facility").otherwise("network")
    return rolled.select(
        level.alias("level"), "facility_id", "department", "series", "capacity",
        S.round_binary(F.col("beds"), 1).alias("occupied"),
        S.round_binary(F.col("capacity") - F.col("beds"), 1).alias("available"),
        S.round_binary(S.utilization(F.col("beds"), F.col("capacity")), 3).alias("utilization"),
    )


def admission_patterns(hourly: DataFrame) -> DataFrame:
    """Hour and weekday with the highest mean admissions.

    Ties go to the smallest hour and to the first day name. Hours and days are both re-aggregated from
    168 sums per facility, so the hourly rows are shuffled once, after map-side sums.
    """
    grid = hourly.groupBy("facility_id", F.hour("ts").alias("hour"), F.date_format("ts", "EEEE").alias("day")).agg(
        F.sum("admissions").alias("total"), F.count("admissions").alias("n")
    )
    mean = F.sum("total") / F.sum("n")
    hours = grid.groupBy("facility_id", "hour").agg(mean.alias("mean")).groupBy("facility_id").agg(
        F.min_by("hour", F.struct(-F.col("mean"), F.col("hour"))).alias("hour")
    )
    days = grid.groupBy("facility_id", "day").agg(mean.alias("mean")).groupBy("facility_id").agg(
        F.min_by("day", F.struct(-F.col("mean"), F.col("day"))).alias("busiest_day")
    )
    return hours.join(days, "facility_id").select(
        "facility_id", F.format_string("%02d:00", F.col("hour")).alias("peak_admission_hour"), "busiest_day"
    )


def overview_analytics(hourly: DataFrame) -> DataFrame:
    """Peak hour, busiest day, the stay estimate and the current outbreak pressure.

    ``average_length_of_stay_hours`` is mean ward occupancy over mean hourly discharges (at least 1),
    times 24, at least 8. ``little_law_hours`` is the estimate in hours: mean occupancy over mean hourly
    admissions.
    """
    stay = F.col("mean_ward") / F.greatest(F.col("mean_discharges"), F.lit(1.0)) * F.lit(24.0)
    return snapshot(hourly).join(admission_patterns(hourly), "facility_id").select(
        "facility_id", "peak_admission_hour", "busiest_day",
        F.greatest(F.lit(8.0), S.round_binary(stay, 1)).alias("average_length_of_stay_hours"),
        S.round_binary(F.col("latest_outbreak_signal"), 3).alias("outbreak_pressure_index"),
        S.round_binary(F.try_divide(F.col("mean_total"), F.col("mean_admissions")), 1).alias("little_law_hours"),
    )
