"""Recursive forecast: each predicted hour is a lag of the next ones.

Spark prepares one row per facility, department and scenario: the 72 hours before the forecast and the
features of the future hours that need no prediction. The steps run inside Arrow batches, for all series
of a batch at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bedtide import config as C
from bedtide.operators.forecast import SERIES, prediction_band
from bedtide.operators.hourly import by_department
from bedtide.operators.quality import clamp_horizon
from bedtide.operators.scenarios import future_frame
from bedtide.operators.training import ForecastModels, tree_tables

KNOWN_FEATURES = C.CALENDAR_FEATURES + C.EXOGENOUS + C.EXOGENOUS_ROLLING_FEATURES
MEMORY = max(C.TARGET_LAGS + C.TARGET_WINDOWS)
CHUNK = 1000


MAX_NODES = 4_000_000  # of all trees of a department, as rectangular arrays: 160 MB


def tree_arrays(spark: SparkSession, models: ForecastModels) -> dict[str, dict[str, np.ndarray]]:
    """Trees as rectangular arrays (tree, node) per department: 150 x 127 nodes at the default settings."""
    nodes = tree_tables(spark, models).toPandas()
    arrays = {}
    for department, rows in nodes.groupby("department"):
        shape = (rows["tree"].max() + 1, rows["node"].max() + 1)
        if shape[0] * shape[1] > MAX_NODES:
            raise ValueError(f"The {department} model has too many nodes to be broadcast; lower maxIter or maxDepth.")
        filled = {name: np.full(shape, -1) for name in ("feature", "left", "right")}
        filled |= {name: np.zeros(shape) for name in ("threshold", "value", "rows")}
        at = (rows["tree"].to_numpy(), rows["node"].to_numpy())
        for name, array in filled.items():
            array[at] = rows[name].fillna(0.0).to_numpy()
        weights = np.zeros(shape[0])
        weights[at[0]] = rows["weight"].to_numpy()
        arrays[department] = filled | {"weight": weights}
    return arrays


def predict(trees: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Ensemble prediction for the rows of ``x``: walk all trees of all rows one level at a time. An unknown value
    goes to the child that saw more training rows."""
    tree = np.arange(len(trees["weight"]))
    row = np.arange(len(x))[:, None]
    node = np.zeros((len(x), len(tree)), dtype=np.int64)
    while True:
        left = trees["left"][tree, node]
        inner = left >= 0
        if not inner.any():
            return trees["value"][tree, node] @ trees["weight"]
        right, value = trees["right"][tree, node], x[row, np.maximum(trees["feature"][tree, node], 0)]
        fuller = trees["rows"][tree, np.maximum(left, 0)] >= trees["rows"][tree, np.maximum(right, 0)]
        go_left = np.where(np.isnan(value), fuller, value <= trees["threshold"][tree, node])
        node = np.where(inner, np.where(go_left, left, right), node)


def roll_forward(trees, known, history, capacity, shift, constant) -> np.ndarray:
    """Step all series through the horizon.

    ``constant`` has the SERIES_FEATURES of each series, ``known`` is (series, step, feature), ``history`` (series, 72) in beds and oldest first, ``shift``
    (series, step) the scenario's beds. The value fed back is the clamped one, unrounded.
    """
    series, steps, _ = known.shape
    past = np.concatenate([history, np.empty((series, steps))], axis=1)
    column = {name: i for i, name in enumerate(C.MODEL_FEATURES)}
    x = np.empty((series, len(C.MODEL_FEATURES)))
    x[:, [column[name] for name in C.SERIES_FEATURES]] = constant
    known_at = [column[name] for name in KNOWN_FEATURES]
    for step in range(steps):
        now = MEMORY + step
        x[:, known_at] = known[:, step]
        for k in C.TARGET_LAGS:
            x[:, column[f"lag_{k}"]] = past[:, now - k] / capacity
        for w in C.TARGET_WINDOWS:
            x[:, column[f"rolling_mean_{w}"]] = np.nanmean(past[:, now - w:now], axis=1) / capacity
        value = predict(trees, x) * capacity + shift[:, step]
        past[:, now] = np.clip(value, 0.0, capacity)
    return past[:, MEMORY:]


def _ordered(value):
    return F.transform(F.sort_array(F.collect_list(value)), lambda s: s["v"])


def recent_history(hourly: DataFrame) -> DataFrame:
    """(facility_id, department, history), the last 72 hours at most, oldest first."""
    newest_first = Window.partitionBy("facility_id").orderBy(F.desc("ts"))
    tail = hourly.withColumn("back", F.row_number().over(newest_first)).where(F.col("back") <= MEMORY)
    return (
        by_department(tail, "back")
        .groupBy("facility_id", "department")
        .agg(_ordered(F.struct((-F.col("back")).alias("at"), F.col("occupied").alias("v"))).alias("history"))
    )


def series_rows(hourly: DataFrame, future: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row per series. The arrays hold 72 hours and at most 168 steps, so a row stays under 25 KB."""
    history = recent_history(hourly)
    numbers = F.array(*[F.col(c).cast("double") for c in KNOWN_FEATURES])
    shift = F.when(F.col("active"), F.col("occupancy_delta")).otherwise(F.lit(0.0))
    ahead = future.groupBy("facility_id", "scenario_id").agg(
        F.min("ts").alias("first_ts"),
        F.flatten(_ordered(F.struct("step", numbers.alias("v")))).alias("known"),
        _ordered(F.struct("step", shift.alias("v"))).alias("shift"),
    )
    constant = F.array(*C.SERIES_FEATURES).alias("constant")
    return history.join(metrics.select("facility_id", "department", "rmse", "capacity", constant), ["facility_id", "department"]).join(
        ahead, "facility_id"
    )


def gbt_forecast(hourly: DataFrame, models: ForecastModels, scenarios: DataFrame, horizon: int | None = C.HORIZON_DEFAULT) -> DataFrame:
    """Forecast points of every facility, department and scenario; a horizon is clamped to the bounds."""
    horizon = None if horizon is None else clamp_horizon(horizon)
    spark = hourly.sparkSession
    ensembles = spark.sparkContext.broadcast(tree_arrays(spark, models))

    @F.pandas_udf("array<double>")
    def rolled(department: pd.Series, history: pd.Series, known: pd.Series, shift: pd.Series, capacity: pd.Series, constant: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(department), dtype=object)
        groups = pd.DataFrame({"department": department, "steps": shift.map(len)}).groupby(["department", "steps"])
        for (name, steps), at in groups.indices.items():
            for part in np.array_split(at, -(-len(at) // CHUNK)):
                values = roll_forward(
                    ensembles.value[name],
                    np.stack(known.iloc[part]).reshape(len(part), steps, len(KNOWN_FEATURES)).astype(float),
                    np.stack([np.concatenate([np.full(MEMORY - len(h), np.nan), h]) for h in history.iloc[part]]).astype(float),
                    capacity.iloc[part].to_numpy(float),
                    np.stack(shift.iloc[part]).astype(float),
                    np.stack(constant.iloc[part]).astype(float),
                )
                for position, row in zip(part, values):
                    out.iloc[position] = row
        return out

    future = future_frame(hourly, scenarios, horizon)
    rows = series_rows(hourly, future, models.metrics).withColumn(
        "values", rolled("department", "history", "known", "shift", F.col("capacity").cast("double"), "constant")
    )
    steps = rows.select(
        *SERIES, "first_ts", "rmse", "capacity", F.posexplode("values").alias("at", "predicted")
    ).withColumns({
        "step": F.col("at") + 1,
        "ts": F.timestamp_micros(F.unix_micros("first_ts") + F.col("at").cast("bigint") * 3_600_000_000),
    })
    return prediction_band(steps)
