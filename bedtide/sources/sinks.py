"""Sinks: the normalised hourly table, the raw zone, the dataset manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bedtide import config as C


def write_hourly(hourly: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Sorted by facility and hour within each file, so that a reader of one facility skips the row groups of others by their
    statistics. There is no folder for each facility: millions of them would be millions of files."""
    if fmt == "parquet":
        hourly.sortWithinPartitions("facility_id", "ts").write.mode(mode).parquet(path)
    elif fmt == "csv":
        hourly.write.mode(mode).option("header", True).csv(path)
    else:
        raise ValueError(f"Unknown sink format: {fmt}")


def write_raw(raw: DataFrame, path: str, ingest_id: str) -> None:
    """Keep what was delivered, unchanged, one partition per delivery."""
    raw.withColumn("_ingest_id", F.lit(ingest_id)).write.mode("append").partitionBy("_ingest_id").parquet(path)


def dataset_manifest(metadata: DataFrame, encounters: DataFrame, profile: str) -> DataFrame:
    """One JSON manifest per facility: source rows, hourly rows and the dataset metadata."""
    counted = encounters.groupBy("facility_id").agg(F.count(F.lit(1)).alias("rows"))
    body = F.to_json(F.struct(
        F.concat(F.lit(f"{profile} "), F.col("facility_id")).alias("profile"),
        F.col("source_rows").alias("rows"),
        F.col("rows").alias("hourly_rows"),
        F.struct(
            "source_name", "source_type", "rows", "coverage_start", "coverage_end",
            F.struct(*[F.col(f"capacity_{d}").alias(d) for d in C.DEPARTMENTS]).alias("capacities"),
        ).alias("metadata"),
    ))
    return metadata.join(counted.withColumnRenamed("rows", "source_rows"), "facility_id").select(
        "facility_id", "source_rows", F.col("rows").alias("hourly_rows"), body.alias("manifest")
    )
