"""Scenario axis and the known part of the future: calendar, projected flows, their rolling means."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bedtide import config as C
from bedtide.functions import scalar as S
from bedtide.operators.profile import dense_profile

SCENARIO_COLUMNS = ["facility_id", "scenario_id", "name", *C.SCENARIO_BOUNDS]


@dataclass(frozen=True)
class Scenario:
    """What-if inputs; the defaults change nothing."""

    name: str
    description: str = ""
    admissions_multiplier: float = 1.0
    discharges_multiplier: float = 1.0
    emergency_multiplier: float = 1.0
    outbreak_delta: float = 0.0
    occupancy_delta: float = 0.0
    duration_hours: int = C.HORIZON_DEFAULT

    def columns(self, scenario_id: int) -> Column:
        return F.struct(
            F.lit(scenario_id).cast("bigint").alias("scenario_id"),
            F.lit(self.name).alias("name"),
            *[
                F.lit(getattr(self, c)).cast("int" if c == "duration_hours" else "double").alias(c)
                for c in C.SCENARIO_BOUNDS
            ],
        )


def facilities_of(hourly: DataFrame) -> DataFrame:
    return hourly.select("facility_id").distinct()


def scenarios_for(facilities: DataFrame, scenarios: list[Scenario], first_id: int = 1) -> DataFrame:
    """The given scenarios for every facility."""
    listed = F.array(*[s.columns(first_id + i) for i, s in enumerate(scenarios)])
    return facilities.select("facility_id", F.inline(listed))


def baseline(facilities: DataFrame) -> DataFrame:
    """Scenario 0: active for no hour, so the projection stays as it is."""
    return scenarios_for(facilities, [Scenario("baseline", duration_hours=0)], C.BASELINE_SCENARIO)


def projected_hours(hourly: DataFrame, horizon: int, columns: list[str] | None = None) -> DataFrame:
    """The next ``horizon`` hours of every facility with the profile value of each column."""
    last = hourly.groupBy("facility_id").agg(F.max("ts").alias("last_ts"))
    hours = last.select("facility_id", "last_ts", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")).select(
        "facility_id", "step", S.plus_hours(F.col("last_ts"), F.col("step")).alias("ts")
    )
    slots = hours.withColumns({"dow": F.weekday("ts"), "hour": F.hour("ts")})
    return slots.join(dense_profile(hourly, columns), ["facility_id", "dow", "hour"], "left").drop("dow", "hour")


def with_scenarios(hours: DataFrame, scenarios: DataFrame, horizon: int | None) -> DataFrame:
    """One copy of a facility's future per scenario of that facility, ``active`` while the scenario lasts.

    Without a horizon each scenario is followed for its own duration.
    """
    length = F.lit(horizon) if horizon is not None else S.clamp(
        F.col("duration_hours"), F.lit(C.HORIZON_MIN), F.lit(C.HORIZON_MAX)
    )
    return hours.join(scenarios.select(*SCENARIO_COLUMNS), "facility_id").where(F.col("step") <= length).withColumn(
        "active", F.col("step") <= F.col("duration_hours")
    )


def apply_scenario(rows: DataFrame) -> DataFrame:
    """Scale the three flows and shift the signal, kept in 0..1, in the hours a scenario is active."""
    active = F.col("active")
    scaled = {
        flow: F.when(active, F.col(flow) * F.col(factor)).otherwise(F.col(flow))
        for flow, factor in [
            ("admissions", "admissions_multiplier"),
            ("discharges", "discharges_multiplier"),
            ("emergency_cases", "emergency_multiplier"),
        ]
    }
    shifted = S.clamp(F.col("outbreak_signal") + F.col("outbreak_delta"), 0.0, 1.0)
    return rows.withColumns(scaled | {"outbreak_signal": F.when(active, shifted).otherwise(F.col("outbreak_signal"))})


def future_frame(hourly: DataFrame, scenarios: DataFrame, horizon: int | None = C.HORIZON_DEFAULT) -> DataFrame:
    """Every feature of the future rows that does not depend on predictions: calendar, exogenous, and the
    rolling means over the 24 rows before, observed or projected (unknown ones skipped)."""
    reach = C.HORIZON_MAX if horizon is None else horizon
    future = apply_scenario(with_scenarios(projected_hours(hourly, reach), scenarios, horizon))
    newest_first = Window.partitionBy("facility_id").orderBy(F.desc("ts"))
    recent = hourly.select("facility_id", "ts", *C.EXOGENOUS, F.row_number().over(newest_first).alias("back")).where(
        F.col("back") <= C.EXOGENOUS_WINDOW
    )
    past = recent.join(scenarios.select("facility_id", "scenario_id"), "facility_id").select(
        "facility_id", "scenario_id", "ts", *[F.col(c).cast("double").alias(c) for c in C.EXOGENOUS]
    )
    before = Window.partitionBy("facility_id", "scenario_id").orderBy("ts").rowsBetween(-C.EXOGENOUS_WINDOW, -1)
    flows = ["admissions", "discharges", "emergency_cases"]
    joined = past.unionByName(future, allowMissingColumns=True).withColumns(
        {name: F.avg(c).over(before) for name, c in zip(C.EXOGENOUS_ROLLING_FEATURES, flows)}
    )
    return joined.where(F.col("step").isNotNull()).withColumns(S.calendar(F.col("ts"))).select(
        "facility_id", "scenario_id", "step", "ts", "active", "occupancy_delta", "profile_fallback",
        *C.CALENDAR_FEATURES, *C.EXOGENOUS, *C.EXOGENOUS_ROLLING_FEATURES,
    )
