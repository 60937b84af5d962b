"""A linear forecaster for each facility and department, fitted from sums.

All a ridge regression needs of its rows are their number, the sums of its columns and of the products of any two. One
map-side aggregate gathers them, 351 numbers for a series and half of the split; the fit on the early rows, its error on
the late ones and the fit on all rows follow from the sums alone, so that the features are read once and nothing is
iterated over them. The recursion runs as an expression over arrays: no Python touches a step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bedtide import config as C
from bedtide.operators.capacity import capacities
from bedtide.operators.features import time_split, training_frame
from bedtide.operators.forecast import SERIES, prediction_band
from bedtide.operators.quality import clamp_horizon
from bedtide.operators.recursive import KNOWN_FEATURES, MEMORY, recent_history
from bedtide.operators.scenarios import future_frame
from bedtide.session import materialise

KEY = ["facility_id", "department"]
COLUMNS = [*C.FEATURES, "target"]
PAIRS = [(i, j) for i in range(len(COLUMNS)) for j in range(i, len(COLUMNS))]
PENALTY = 1e-3  # on standardised features, as a share of the rows
FLAT = 1e-12  # share of its square below which a feature's variance is none


@dataclass
class RidgeModels:
    """One row per series: weights (features, then the constant), error, capacity, and how well the equations are solved."""

    table: DataFrame


def moments(training: DataFrame) -> DataFrame:
    """(facility_id, department, is_train, n, sums, products) of training rows marked by ``time_split``."""
    value = [F.col(c).cast("double") for c in COLUMNS]
    summed = training.groupBy(*KEY, "is_train").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(v).alias(f"s{i}") for i, v in enumerate(value)],
        *[F.sum(value[i] * value[j]).alias(f"p{k}") for k, (i, j) in enumerate(PAIRS)],
    )
    return summed.select(
        *KEY, "is_train", "n", F.array(*[f"s{i}" for i in range(len(COLUMNS))]).alias("sums"), F.array(*[f"p{k}" for k in range(len(PAIRS))]).alias("products"))


def _square(products: np.ndarray) -> np.ndarray:
    """Symmetric matrices from their upper halves, a row each."""
    upper, lower = (np.array(x) for x in zip(*PAIRS))
    full = np.empty((len(products), len(COLUMNS), len(COLUMNS)))
    full[:, upper, lower] = products
    full[:, lower, upper] = products
    return full


def solve(n: np.ndarray, sums: np.ndarray, products: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """Weights of all series at once, the constant last, and the largest residual of each one's normal equations.

    The equations are those of standardised columns; a feature without variance gets weight 0.
    """
    mean = sums / n[:, None]
    centred = _square(products) / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    variance, square = np.diagonal(centred, axis1=1, axis2=2)[:, :-1], np.diagonal(_square(products), axis1=1, axis2=2)[:, :-1] / n[:, None]
    flat = variance <= FLAT * np.maximum(square, 1.0)
    scale = np.sqrt(np.where(flat, 1.0, variance))
    a = np.where(flat[:, :, None] | flat[:, None, :], 0.0, centred[:, :-1, :-1] / (scale[:, :, None] * scale[:, None, :])) + penalty * np.eye(scale.shape[1])
    b = np.where(flat, 0.0, centred[:, :-1, -1] / scale)
    root = np.linalg.cholesky(a)
    found = np.linalg.solve(np.swapaxes(root, 1, 2), np.linalg.solve(root, b[:, :, None]))[:, :, 0]
    residual = np.abs((a @ found[:, :, None])[:, :, 0] - b).max(axis=1)
    weights = found / scale
    return np.concatenate([weights, (mean[:, -1] - (weights * mean[:, :-1]).sum(axis=1))[:, None]], axis=1), residual


def squared_error(n: np.ndarray, sums: np.ndarray, products: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum of squared errors of ``weights`` on rows known by their sums: target minus features minus constant, squared."""
    factor = np.concatenate([-weights[:, :-1], np.ones((len(weights), 1))], axis=1)
    constant = weights[:, -1]
    square = (factor[:, :, None] * _square(products) * factor[:, None, :]).sum(axis=(1, 2))
    return np.maximum(square - 2 * constant * (factor * sums).sum(axis=1) + n * constant * constant, 0.0)


def train(hourly: DataFrame, penalty: float = PENALTY) -> RidgeModels:
    """Fit every series of the hourly fact.

    The error is that of a fit on the first 85 % of a series' rows on the others, 0.15 standard deviations where there are no others,
    and at least 1.5; the weights are those of a fit on all rows. A series without a training row has no model.
    """
    halves = materialise(moments(time_split(training_frame(hourly))))
    part = lambda flag, name: halves.where(F.col("is_train") == flag).select(*KEY, F.struct("n", "sums", "products").alias(name))
    series = part(True, "early").join(part(False, "late"), KEY, "left")

    @F.pandas_udf("weights array<double>, error double, spread double, residual double, usual double, rows bigint")
    def fitted(early: pd.DataFrame, late: pd.DataFrame) -> pd.DataFrame:
        arrays = lambda f: (f["n"].to_numpy(float), np.stack(f["sums"]).astype(float), np.stack(f["products"]).astype(float))
        first = arrays(early)
        some = late["n"].notna().to_numpy()
        second = tuple(np.zeros_like(x) for x in first)
        if some.any():
            for whole, x in zip(second, arrays(late[some])):
                whole[some] = x
        total = tuple(x + y for x, y in zip(first, second))
        error = np.sqrt(squared_error(*second, solve(*first, penalty)[0]) / np.maximum(second[0], 1))
        weights, residual = solve(*total, penalty)
        mean = total[1][:, -1] / total[0]
        spread = np.sqrt(np.maximum(total[2][:, -1] - total[0] * mean * mean, 0) / np.maximum(total[0] - 1, 1))
        return pd.DataFrame({"weights": list(weights), "error": np.where(some, error, np.nan), "spread": spread, "residual": residual, "usual": mean, "rows": total[0].astype(int)})

    solved = series.select(*KEY, fitted("early", "late").alias("m")).select(*KEY, "m.*")
    error = F.when(F.isnan("error"), None).otherwise(F.col("error"))
    rmse = F.greatest(F.lit(C.RMSE_FLOOR), F.coalesce(error, F.col("spread") * F.lit(0.15)))
    return RidgeModels(materialise(solved.select(*KEY, "weights", rmse.alias("rmse"), "residual", "usual", "rows").join(capacities(hourly), KEY)))


def _weight(name: str) -> Column:
    return F.get("weights", F.lit(C.FEATURES.index(name)))


def _next_value(past: Column, base: Column) -> Column:
    """What the weights say of the hour after ``past`` (oldest first), given the part that doesn't depend on it."""
    value = base
    for k in C.TARGET_LAGS:
        value = value + _weight(f"lag_{k}") * F.element_at(past, F.lit(-k))
    for w in C.TARGET_WINDOWS:
        window = F.aggregate(F.slice(past, -w, w), F.lit(0.0), lambda total, x: total + x)
        value = value + _weight(f"rolling_mean_{w}") * window / F.lit(float(w))
    return value


def ridge_forecast(hourly: DataFrame, models: RidgeModels, scenarios: DataFrame, horizon: int | None = C.HORIZON_DEFAULT) -> DataFrame:
    """Forecast points of every facility, department and scenario; a horizon is clamped to the bounds.

    Each predicted hour, with the scenario's beds added and kept between 0 and the capacity, is a lag of the next ones. Past hours that
    are unknown or before the series count as its mean.
    """
    horizon = None if horizon is None else clamp_horizon(horizon)
    known = F.get("weights", F.lit(len(C.FEATURES)))
    for name in KNOWN_FEATURES:
        known = known + _weight(name) * F.col(name).cast("double")
    shift = F.when(F.col("active"), F.col("occupancy_delta")).otherwise(F.lit(0.0))
    ahead = future_frame(hourly, scenarios, horizon).join(models.table.select(*KEY, "weights"), "facility_id")
    steps = ahead.groupBy("facility_id", "scenario_id", "department").agg(
        F.min("ts").alias("first_ts"), F.sort_array(F.collect_list(F.struct("step", known.alias("base"), shift.alias("shift")))).alias("steps"))
    whole = recent_history(hourly).select(*KEY, "history").join(models.table, KEY).join(steps, KEY)
    past = F.transform("history", lambda x: F.coalesce(x, F.col("usual")))
    full = F.concat(F.array_repeat(F.col("usual"), F.lit(MEMORY) - F.size("history")), past)
    capacity = F.col("capacity").cast("double")
    rolled = F.aggregate("steps", full, lambda acc, s: F.concat(
        acc, F.array(F.least(capacity, F.greatest(F.lit(0.0), _next_value(acc, s["base"]) + s["shift"])))))
    values = whole.select(*SERIES, "first_ts", "rmse", "capacity", F.posexplode(F.slice(rolled, MEMORY + 1, F.size("steps"))).alias("at", "predicted"))
    return prediction_band(values.withColumns({
        "step": F.col("at") + 1,
        "ts": F.timestamp_micros(F.unix_micros("first_ts") + F.col("at").cast("bigint") * 3_600_000_000),
    }))
