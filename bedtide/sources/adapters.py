"""Projections that present the shared test tables as encounters and readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bedtide.session import utc
from bedtide.sources.readers import canonical_encounters, canonical_readings

DEPARTMENT_OF_EVENT = {
    "error": "ICU", "click": "Emergency Department", "view": "Pediatric Ward",
    "signup": "Trauma ED", "purchase": "General Ward",
}
TYPE_OF_EVENT = ["Emergency", "Scheduled", "Direct", "Walk-in"]
DEPARTMENT_OF_STATUS = {"F": "ICU", "O": "General Ward", "P": "Child Health"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _lookup(column, pairs: dict[str, str]):
    value = F.lit(None).cast("string")
    for key, text in pairs.items():
        value = F.when(column == key, text).otherwise(value)
    return value


def event_encounters(events: DataFrame) -> DataFrame:
    """Events as encounters of four facilities; some lack a discharge, some have one before admission."""
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    stay = F.round(F.col("value") * 3600).cast("bigint") * 1_000_000
    number = F.col("event_id")
    kind = number % 4
    admission_type = F.lit(None).cast("string")
    for index, text in enumerate(TYPE_OF_EVENT):
        admission_type = F.when(kind == index, text).otherwise(admission_type)
    return events.select(
        (F.col("user_id") % 4).cast("string").alias("facility_id"),
        number.cast("string").alias("patient_id"),
        F.col("ts").cast("timestamp").alias("admission_time"),
        F.when(number % 17 == 0, F.lit(None))
        .when(number % 23 == 0, F.timestamp_micros(ts - 5 * 3_600_000_000))
        .otherwise(F.timestamp_micros(ts + stay)).alias("discharge_time"),
        _lookup(F.col("event_type"), DEPARTMENT_OF_EVENT).alias("department"),
        admission_type.alias("admission_type"),
    )


def encounters_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_encounters(event_encounters(table(spark, sf_dir, "events")))


def encounters_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as encounters of eight facilities; about half of the stays need imputation."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return canonical_encounters(joined.select(
        (F.col("l_suppkey") % 8).cast("string").alias("facility_id"),
        F.concat_ws("-", F.col("l_orderkey"), F.col("l_linenumber")).alias("patient_id"),
        F.col("o_orderdate").cast("timestamp").alias("admission_time"),
        F.col("l_shipdate").cast("timestamp").alias("discharge_time"),
        _lookup(F.col("o_orderstatus"), DEPARTMENT_OF_STATUS).alias("department"),
        F.col("o_orderpriority").alias("admission_type"),
    ))


def readings_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as occupancy readings without an outbreak column. Each user belongs to one of 32 facilities,
    so at the smaller scales hours without a reading occur."""
    events = table(spark, sf_dir, "events")
    return canonical_readings(events.select(
        (F.col("user_id") % 32).cast("string").alias("facility_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        (F.col("event_id") % 3).alias("admissions"),
        (F.col("event_id") % 2).alias("discharges"),
        (F.col("event_type") == "error").cast("int").alias("emergency_cases"),
        F.col("value").alias("icu_occupied"),
        (F.col("value") / 2).alias("ward_occupied"),
        (F.col("value") / 4).alias("emergency_occupied"),
        (F.col("value") / 8).alias("pediatric_occupied"),
    ))
