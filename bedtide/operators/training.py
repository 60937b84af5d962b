"""Learned forecasters: one boosted-tree model per department, fitted over all facilities with MLlib."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bedtide import config as C
from bedtide.functions import scalar as S
from bedtide.operators.capacity import capacities
from bedtide.operators.features import observed_range, time_split, training_frame
from bedtide.session import materialise, scratch_path, shared_folder

# Features in beds. They and the target are divided by capacity, so that one model serves large and small
# facilities; for a single facility this rescales the axes and leaves the trees as they were.
BED_FEATURES = C.LAG_FEATURES + C.ROLLING_FEATURES


@dataclass
class ForecastModels:
    """Where the fitted trees lie, and the small tables read next to them."""

    paths: dict[str, str]
    metrics: DataFrame
    trained_at: str | None = None

    def model(self, department: str) -> GBTRegressionModel:
        return GBTRegressionModel.load(self.paths[department])


def series_features(training: DataFrame) -> DataFrame:
    """(facility_id, department, the three SERIES_FEATURES) from the rows marked ``is_train``."""
    share = F.when(F.col("is_train"), F.col("target") / F.col("capacity"))
    return training.groupBy("facility_id", "department").agg(
        F.max("capacity").cast("double").alias("capacity_beds"), F.avg(share).alias("usual_share"),
        F.coalesce(F.stddev_samp(share), F.lit(0.0)).alias("share_deviation"),
    )


def scaled_frame(training: DataFrame) -> DataFrame:
    """Training rows, with their ``capacity`` and SERIES_FEATURES, to shares of capacity and the feature vector."""
    share = {c: F.col(c) / F.col("capacity") for c in BED_FEATURES}
    scaled = training.withColumns(share | {"label": F.col("target") / F.col("capacity")})
    return VectorAssembler(inputCols=C.MODEL_FEATURES, outputCol="features").transform(scaled)


def _regressor(settings: dict) -> GBTRegressor:
    return GBTRegressor(featuresCol="features", labelCol="label", cacheNodeIds=True, checkpointInterval=25, maxMemoryInMB=512, **settings)


def validation_errors(scored: DataFrame) -> DataFrame:
    """(facility_id, department, rmse) in beds; 0.15 standard deviations where nothing could be scored, at
    least 1.5."""
    error = (F.col("label") - F.col("prediction")) * F.col("capacity")
    scored = scored.withColumn("error", F.when(~F.col("is_train"), error * error))
    per_series = scored.groupBy("facility_id", "department").agg(
        F.sqrt(F.avg("error")).alias("error"), (F.stddev_samp("target") * F.lit(0.15)).alias("spread")
    )
    return per_series.select(
        "facility_id", "department", F.greatest(F.lit(C.RMSE_FLOOR), F.coalesce("error", "spread")).alias("rmse")
    )


def train_all(hourly: DataFrame, trained_at: str | None = None, **settings) -> ForecastModels:
    """Fit and score every department.

    Per department the model is fitted on the first 85 % of each facility's rows and scored on the rest,
    then fitted again on all rows; that is 8 fits however many facilities there are. The feature table is
    written to the shared folder once and read by all fits, which run side by side. ``settings`` override
    the learner's defaults (``maxIter=20``).
    """
    spark = hourly.sparkSession
    shared_folder(spark)
    capacity = capacities(hourly)
    training = time_split(training_frame(hourly))
    prepared = materialise(training.join(capacity, ["facility_id", "department"]))
    usual = materialise(series_features(prepared))
    frames = materialise(scaled_frame(prepared.join(usual, ["facility_id", "department"])).select(
        "facility_id", "department", "is_train", "target", "capacity", "label", "features"))
    options = C.LEARNER | settings

    def fit(department: str) -> tuple[str, str, DataFrame]:
        rows = frames.where(F.col("department") == department).persist()
        try:
            if rows.isEmpty():
                raise ValueError(f"Insufficient training rows for {department} forecast model.")
            candidate = _regressor(options).fit(rows.where("is_train"))
            errors = materialise(validation_errors(candidate.transform(rows)))
            path = scratch_path(spark, f"model-{department}")
            _regressor(options).fit(rows).write().save(path)
        finally:
            rows.unpersist()
        return department, path, errors

    with ThreadPoolExecutor(max_workers=len(C.DEPARTMENTS)) as pool:
        fitted = list(pool.map(fit, C.DEPARTMENTS))
    errors = fitted[0][2]
    for _, _, more in fitted[1:]:
        errors = errors.unionByName(more)
    metrics = materialise(
        errors.join(capacity, ["facility_id", "department"])
        .join(observed_range(prepared), ["facility_id", "department"])
        .join(usual, ["facility_id", "department"])
    )
    return ForecastModels({department: path for department, path, _ in fitted}, metrics, trained_at)


def model_metrics(models: ForecastModels) -> DataFrame:
    """Presented error and capacity per department."""
    return models.metrics.select("facility_id", "department", S.round_binary(F.col("rmse"), 2).alias("rmse"), "capacity")


def tree_tables(spark: SparkSession, models: ForecastModels) -> DataFrame:
    """The saved trees as rows: department, tree, node, split or leaf. At most 127 nodes a tree."""
    tables = []
    for department, path in models.paths.items():
        weights = spark.read.parquet(f"{path}/treesMetadata").select(
            F.col("_1").alias("tree"), F.col("_3").alias("weight")
        )
        nodes = spark.read.parquet(f"{path}/data").select(
            F.lit(department).alias("department"),
            F.col("treeID").alias("tree"),
            F.col("nodeData.id").alias("node"),
            F.col("nodeData.prediction").alias("value"),
            F.col("nodeData.rawCount").alias("rows"),
            F.col("nodeData.leftChild").alias("left"),
            F.col("nodeData.rightChild").alias("right"),
            F.col("nodeData.split.featureIndex").alias("feature"),
            F.get("nodeData.split.leftCategoriesOrThreshold", 0).alias("threshold"),
        )
        tables.append(nodes.join(weights, "tree"))
    result = tables[0]
    for table in tables[1:]:
        result = result.unionByName(table)
    return result
