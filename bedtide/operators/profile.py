"""Weekly profiles: the mean of a column by weekday and hour."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bedtide import config as C


def exogenous_profile(hourly: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Means by (facility, weekday, hour) for the hours that were observed."""
    return hourly.groupBy("facility_id", F.weekday("ts").alias("dow"), F.hour("ts").alias("hour")).agg(
        *[F.avg(c).alias(c) for c in columns or C.EXOGENOUS]
    )


def dense_profile(hourly: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """All 168 weekday-hours of every facility.

    A weekday-hour never observed takes the mean of its hour over the other days, then the mean of the
    facility, and is marked ``profile_fallback``.
    """
    columns = columns or C.EXOGENOUS
    observed = hourly.groupBy("facility_id", F.weekday("ts").alias("dow"), F.hour("ts").alias("hour")).agg(
        *[F.sum(F.col(c).cast("double")).alias(f"{c}_sum") for c in columns],
        *[F.count(c).alias(f"{c}_n") for c in columns],
        F.count(F.lit(1)).alias("seen"),
    )
    grid = (
        observed.select("facility_id").distinct()
        .select("facility_id", F.explode(F.sequence(F.lit(0), F.lit(167))).alias("slot"))
        .select("facility_id", F.floor(F.col("slot") / 24).cast("int").alias("dow"), (F.col("slot") % 24).alias("hour"))
    )
    filled = grid.join(observed, ["facility_id", "dow", "hour"], "left")
    same_hour, whole = Window.partitionBy("facility_id", "hour"), Window.partitionBy("facility_id")

    def mean(column: str):
        total, n = F.col(f"{column}_sum"), F.col(f"{column}_n")
        return F.coalesce(
            F.try_divide(total, n),
            F.try_divide(F.sum(total).over(same_hour), F.sum(n).over(same_hour)),
            F.try_divide(F.sum(total).over(whole), F.sum(n).over(whole)),
        ).alias(column)

    return filled.select(
        "facility_id", "dow", "hour", *[mean(c) for c in columns], F.col("seen").isNull().alias("profile_fallback")
    )
