"""The span of time that a facility's encounters really cover, and the rows outside it.

One admission dated 0202 or a discharge dated 9999 would stretch a gap-free hourly series over millennia. Days with admissions
that lie within ``max_gap_days`` of one another are a run; the run with most admissions is the facility's span.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_GAP_DAYS = 366


def main_spans(encounters: DataFrame, max_gap_days: int = MAX_GAP_DAYS) -> DataFrame:
    """(facility_id, first_day, last_day): the run of days with most admissions, the latest of equals.

    Admissions are counted by day map-side, so a facility brings its days to the window and not its encounters.
    """
    days = encounters.where("admission_time is not null").groupBy("facility_id", F.to_date("admission_time").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    by_day = Window.partitionBy("facility_id").orderBy("day")
    opens = F.coalesce(F.datediff("day", F.lag("day").over(by_day)) > max_gap_days, F.lit(True)).cast("int")
    runs = days.withColumn("opens", opens).withColumn("run", F.sum("opens").over(by_day))
    sizes = runs.groupBy("facility_id", "run").agg(F.sum("n").alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    best = F.max_by(F.struct("first_day", "last_day"), F.struct("n", "last_day"))
    return sizes.groupBy("facility_id").agg(best.alias("span")).select("facility_id", "span.*")


def _judged(encounters: DataFrame, spans: DataFrame, max_gap_days: int) -> DataFrame:
    """``encounters`` with ``issue``: NULL, or what lies outside the span."""
    admitted, left = F.to_date("admission_time"), F.to_date("discharge_time")
    issue = F.when(~admitted.between(F.col("first_day"), F.col("last_day")), "admission outside span").when(
        left > F.date_add("last_day", max_gap_days), "discharge outside span")
    return encounters.join(spans, "facility_id", "left").withColumn("issue", issue).drop("first_day", "last_day")


def within_span(encounters: DataFrame, spans: DataFrame, max_gap_days: int = MAX_GAP_DAYS) -> DataFrame:
    """``encounters`` without those admitted outside the span; a discharge more than ``max_gap_days`` after its last day counts as
    unknown, so that the default stay takes its place. The series then has no gap of more than ``max_gap_days``."""
    judged = _judged(encounters, spans, max_gap_days)
    late = F.col("issue") == "discharge outside span"
    kept = judged.where(F.col("issue").isNull() | late)
    return kept.withColumn("discharge_time", F.when(late, None).otherwise(F.col("discharge_time"))).select(*encounters.columns)


def span_issues(encounters: DataFrame, spans: DataFrame, max_gap_days: int = MAX_GAP_DAYS) -> DataFrame:
    """(facility_id, issue, rows, first_time, last_time) of what ``within_span`` sets aside or replaces."""
    judged = _judged(encounters, spans, max_gap_days).where("issue is not null")
    time = F.when(F.col("issue") == "admission outside span", F.col("admission_time")).otherwise(F.col("discharge_time"))
    return judged.withColumn("time", time).groupBy("facility_id", "issue").agg(
        F.count(F.lit(1)).alias("rows"), F.min("time").alias("first_time"), F.max("time").alias("last_time"))
