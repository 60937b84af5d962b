"""The hourly fact: flows and occupancy per facility and hour without gaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bedtide import config as C
from bedtide.functions import scalar as S
from bedtide.operators.signal import with_outbreak_signal
from bedtide.operators.span import main_spans, within_span
from bedtide.operators.stays import clean_encounters
from bedtide.session import materialise
from bedtide.sources.readers import total_occupied

FLOWS = ["admissions", "discharges", "emergency_cases"]


def by_time(first: int | None = None, last: int = 0):
    """Rows of one facility in time order. A facility has one row per hour, so a partition grows with the
    calendar (8,784 rows a year at most) and not with its encounters."""
    spec = Window.partitionBy("facility_id").orderBy("ts")
    return spec.rowsBetween(Window.unboundedPreceding if first is None else first, last)


def fill_hours(sparse: DataFrame, flows: list[str], levels: list[str], gap_level: str) -> DataFrame:
    """Give every facility one row per hour between its first and last one.

    Each row is repeated up to the next one of its facility, day by day and then hour by hour, which replaces a spine
    and a join. In the added hours flows are 0; levels are carried (``gap_level="carry"``) or NULL (``"null"``).
    """
    following = F.lead("ts").over(Window.partitionBy("facility_id").orderBy("ts"))
    until = F.coalesce(S.plus_hours(F.col("next_ts"), F.lit(-1)), F.col("ts"))
    day = lambda c: F.date_trunc("day", c)
    days = sparse.withColumn("next_ts", following).withColumn("until", until).withColumn(
        "day_ts", F.explode(F.sequence(day("ts"), day("until"), F.expr("INTERVAL 1 DAY")))
    )
    last = F.least("until", S.plus_hours(F.col("day_ts"), F.lit(23)))
    filled = days.withColumn("hour_ts", F.explode(F.sequence(F.greatest("ts", "day_ts"), last, F.expr("INTERVAL 1 HOUR"))))
    own = F.col("hour_ts") == F.col("ts")
    level = (lambda c: F.col(c)) if gap_level == "carry" else (lambda c: F.when(own, F.col(c)))
    return filled.select(
        "facility_id",
        F.col("hour_ts").alias("ts"),
        *[F.when(own, F.col(c)).otherwise(F.lit(0).cast(sparse.schema[c].dataType)).alias(c) for c in flows],
        *[level(c).alias(c) for c in levels],
    )


def changes(clean: DataFrame) -> DataFrame:
    """Per facility and hour: arrivals, departures, emergency arrivals and the net change of each department.

    Every stay is one +1 and one -1. The two are summed map-side, so the shuffle carries at most
    facilities x hours rows per task and a hot facility is spread by hour.
    """
    deltas = clean.select(
        "facility_id", "mapped_department", "is_emergency",
        F.expr("stack(2, admission_bucket, 1L, 0L, discharge_bucket, 0L, 1L) AS (ts, starts, ends)"),
    )
    net = F.col("starts") - F.col("ends")
    return deltas.groupBy("facility_id", "ts").agg(
        F.sum("starts").alias("admissions"),
        F.sum("ends").alias("discharges"),
        F.sum(F.when(F.col("is_emergency"), F.col("starts")).otherwise(F.lit(0))).alias("emergency_cases"),
        *[
            F.sum(F.when(F.col("mapped_department") == d, net).otherwise(F.lit(0))).alias(f"{d}_change")
            for d in C.DEPARTMENTS
        ],
    )


def hourly_occupancy(clean: DataFrame) -> DataFrame:
    """Cleaned stays to the gap-free hourly table, without the outbreak signal.

    A stay occupies the hours from its admission bucket up to, not including, its discharge bucket.
    """
    running = changes(clean).withColumns({
        f"{d}_occupied": F.greatest(F.sum(f"{d}_change").over(by_time()), F.lit(0)).cast("double")
        for d in C.DEPARTMENTS
    })
    filled = fill_hours(running, FLOWS, C.OCCUPANCY_COLUMNS, "carry")
    return filled.withColumn("total_occupied", total_occupied())


def hourly_from_encounters(encounters: DataFrame, urgency: str = "reference", max_gap_days: int | None = None) -> DataFrame:
    """Canonical encounters to the complete hourly fact.

    With ``max_gap_days`` only the encounters within each facility's span count, see ``span.within_span``.
    """
    if max_gap_days is not None:
        encounters = within_span(encounters, materialise(main_spans(encounters, max_gap_days)), max_gap_days)
    return with_outbreak_signal(hourly_occupancy(clean_encounters(encounters, urgency)))


def hourly_from_readings(readings: DataFrame, derive_outbreak: str = "reference") -> DataFrame:
    """Canonical readings to the complete hourly fact: flows are summed, levels averaged per hour.

    Hours without a reading have flow 0 and unknown levels. The signal is derived for those hours; with
    ``derive_outbreak="when_absent"`` it is derived for all hours of a source that has no such column
    (by default an absent column counts as a signal of 0).
    """
    per_hour = (
        readings.where(F.col("ts").isNotNull())
        .groupBy("facility_id", S.floor_hour(F.col("ts")).alias("ts"))
        .agg(
            *[F.sum(c).alias(c) for c in FLOWS],
            *[F.avg(c).alias(c) for c in ["outbreak_signal", *C.OCCUPANCY_COLUMNS]],
            F.max("outbreak_given").alias("outbreak_given"),
        )
    )
    filled = fill_hours(per_hour, FLOWS, ["outbreak_signal", *C.OCCUPANCY_COLUMNS, "outbreak_given"], "null")
    keep = F.col("outbreak_signal")
    if derive_outbreak == "when_absent":
        keep = F.when(F.col("outbreak_given"), keep)
    given = filled.withColumn("given_signal", keep).drop("outbreak_signal", "outbreak_given")
    derived = with_outbreak_signal(given)
    return (
        derived.withColumn("outbreak_signal", F.coalesce("given_signal", "outbreak_signal"))
        .drop("given_signal")
        .withColumn("total_occupied", total_occupied())
    )


def occupancy_by_overlap(clean: DataFrame) -> DataFrame:
    """Occupied department hours counted straight from the stay intervals, as a check of the running sum.

    Stays with the same interval are counted first; each distinct interval is then spread over its hours.
    Hours in which a department is empty have no row.
    """
    intervals = clean.groupBy("facility_id", "mapped_department", "admission_bucket", "discharge_bucket").agg(
        F.count(F.lit(1)).alias("n")
    )
    last = S.plus_hours(F.col("discharge_bucket"), F.lit(-1))
    return (
        intervals.select(
            "facility_id", F.col("mapped_department").alias("department"),
            F.explode(F.sequence("admission_bucket", last, F.expr("INTERVAL 1 HOUR"))).alias("ts"), "n",
        )
        .groupBy("facility_id", "department", "ts")
        .agg(F.sum("n").cast("double").alias("occupied"))
    )


def up_to(hourly: DataFrame, as_of: Column | str) -> DataFrame:
    """The series as it stood at ``as_of``. On encounter input the last hours only drain, so "latest"
    figures are about an empty building unless a cutoff is given."""
    return hourly.where(F.col("ts") <= (F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of))


def up_to_last_admission(hourly: DataFrame) -> DataFrame:
    """Cut every facility at its last hour with an admission."""
    whole = Window.partitionBy("facility_id")
    last = F.max(F.when(F.col("admissions") > 0, F.col("ts"))).over(whole)
    return hourly.withColumn("cutoff", last).where("ts <= cutoff").drop("cutoff")


def by_department(hourly: DataFrame, *keep: str) -> DataFrame:
    """Wide to long: one row per facility, hour and department."""
    pairs = ", ".join(f"'{d}', {d}_occupied" for d in C.DEPARTMENTS)
    return hourly.select(
        "facility_id", "ts", *keep, F.expr(f"stack({len(C.DEPARTMENTS)}, {pairs}) AS (department, occupied)")
    )


def by_column(long: DataFrame) -> DataFrame:
    """Long to wide, the inverse of ``by_department``."""
    wide = long.groupBy("facility_id", "ts").pivot("department", list(C.DEPARTMENTS)).agg(F.first("occupied"))
    return reduce(lambda df, d: df.withColumnRenamed(d, f"{d}_occupied"), C.DEPARTMENTS, wide)
