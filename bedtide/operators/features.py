"""Training features for all departments at once, from one sort of each facility's hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bedtide import config as C
from bedtide.functions import scalar as S
from bedtide.operators.hourly import by_time


def calendar_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumns(S.calendar(F.col(ts)))


def full_mean(column: str, width: int) -> Column:
    """Mean of the ``width`` rows before this one; NULL unless all of them are there and known."""
    frame = by_time(-width, -1)
    return F.when(F.count(column).over(frame) == width, F.avg(column).over(frame))


def exogenous_rolling() -> dict[str, Column]:
    flows = ["admissions", "discharges", "emergency_cases"]
    return {name: full_mean(c, C.EXOGENOUS_WINDOW) for name, c in zip(C.EXOGENOUS_ROLLING_FEATURES, flows)}


def training_frame(hourly: DataFrame) -> DataFrame:
    """(facility_id, department, ts, target, 24 features).

    A row with an unknown value in any base column is dropped for every department; rows without a full
    72-hour past are dropped too.
    """
    order = Window.partitionBy("facility_id").orderBy("ts")
    wide = hourly.withColumns(exogenous_rolling() | {
        f"{d}_{name}": expression
        for d in C.DEPARTMENTS
        for name, expression in {
            **{f"lag_{k}": F.lag(f"{d}_occupied", k).over(order) for k in C.TARGET_LAGS},
            **{f"rolling_mean_{w}": full_mean(f"{d}_occupied", w) for w in C.TARGET_WINDOWS},
        }.items()
    })
    base = ["ts", *C.EXOGENOUS, *C.OCCUPANCY_COLUMNS, *C.EXOGENOUS_ROLLING_FEATURES]
    known = wide.na.drop("any", subset=base)
    own = C.LAG_FEATURES + C.ROLLING_FEATURES
    departments = F.array(*[
        F.struct(
            F.lit(d).alias("department"),
            F.col(f"{d}_occupied").alias("target"),
            *[F.col(f"{d}_{name}").alias(name) for name in own],
        )
        for d in C.DEPARTMENTS
    ])
    long = known.select("facility_id", "ts", *C.EXOGENOUS, *C.EXOGENOUS_ROLLING_FEATURES, F.inline(departments))
    return calendar_features(long.na.drop("any", subset=own)).select(
        "facility_id", "department", "ts", "target", *C.FEATURES
    )


def time_split(training: DataFrame, keys: tuple[str, ...] = ("facility_id", "department"), share: float = C.TRAIN_SHARE) -> DataFrame:
    """Mark the first 85 % of each series, and at least one row, as ``is_train``."""
    whole = Window.partitionBy(*keys)
    position = F.row_number().over(whole.orderBy("ts"))
    cut = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(whole) * F.lit(share)).cast("int"))
    return training.withColumn("is_train", position <= cut)


def observed_range(training: DataFrame) -> DataFrame:
    return training.groupBy("facility_id", "department").agg(
        F.min("target").alias("min_observed"), F.max("target").alias("max_observed"), F.count(F.lit(1)).alias("rows")
    )
