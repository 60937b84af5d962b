"""Recent history and daily flow per facility."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bedtide import config as C
from bedtide.functions import scalar as S
from bedtide.operators.quality import clamp_history


def occupancy_history(hourly: DataFrame, history_hours: int = C.HISTORY_DEFAULT) -> DataFrame:
    """The last rows of each facility with the four occupancies at one decimal; ``position`` counts from 0."""
    newest_first = Window.partitionBy("facility_id").orderBy(F.desc("ts"))
    recent = hourly.withColumn("back", F.row_number().over(newest_first)).where(
        F.col("back") <= clamp_history(history_hours)
    )
    length = F.max("back").over(Window.partitionBy("facility_id"))
    return recent.select(
        "facility_id",
        (length - F.col("back")).cast("int").alias("position"),
        S.iso(F.col("ts")).alias("timestamp"),
        *[S.round_binary(F.col(f"{d}_occupied"), 1).alias(d) for d in C.DEPARTMENTS],
    )


def downsample(history: DataFrame, every: int = 3) -> DataFrame:
    """Each third point of a history, starting with the first, as plotted."""
    return history.where(F.col("position") % every == 0)


def daily_flow(hourly: DataFrame, days: int = C.DAILY_FLOW_DAYS) -> DataFrame:
    """Admissions, discharges and emergencies per day, for the last days of each facility."""
    flows = ["admissions", "discharges", "emergency_cases"]
    per_day = hourly.groupBy("facility_id", F.to_date("ts").alias("day")).agg(
        *[F.sum(c).cast("bigint").alias(c) for c in flows]
    )
    newest_first = Window.partitionBy("facility_id").orderBy(F.desc("day"))
    return (
        per_day.withColumn("back", F.row_number().over(newest_first))
        .where(F.col("back") <= days)
        .select("facility_id", F.date_format("day", "yyyy-MM-dd").alias("date"), *flows)
    )
