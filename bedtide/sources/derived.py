"""Inputs derived from whole test tables: exports as text files, threshold updates, scenario payloads, settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bedtide.session import scratch_path
from bedtide.sources.adapters import event_encounters, table
from bedtide.sources.readers import canonical_encounters

DEPARTMENT_KEY_OF_EVENT = {
    "error": "icu", "click": "emergency", "view": "pediatric", "purchase": "ward", "signup": "maternity",
}


def _facility():
    return (F.col("user_id") % 4).cast("string").alias("facility_id")


def threshold_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One update per event, three to a request; some name an unknown department or are out of bounds."""
    department = F.create_map(*[F.lit(x) for pair in DEPARTMENT_KEY_OF_EVENT.items() for x in pair])
    return table(spark, sf_dir, "events").select(
        _facility(),
        department[F.col("event_type")].alias("department"),
        (F.lit(0.45) + (F.col("event_id") % 60) / F.lit(100.0)).alias("utilization_threshold"),
        F.col("user_id").cast("string").alias("updated_by"),
        F.col("ts").cast("timestamp").alias("updated_at"),
        F.expr("event_id DIV 3").alias("request_id"),
    )


def what_if_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five scenarios per facility, one per event type, with inputs taken from its event count."""
    events = table(spark, sf_dir, "events")
    number = F.array_position(F.array(*[F.lit(k) for k in DEPARTMENT_KEY_OF_EVENT]), F.col("event_type"))
    counted = events.groupBy(_facility(), "event_type").agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    return counted.select(
        "facility_id",
        number.cast("bigint").alias("scenario_id"),
        F.concat(F.lit("surge of "), F.col("event_type")).alias("name"),
        (F.lit(0.8) + (n % 50) / F.lit(100.0)).alias("admissions_multiplier"),
        (F.lit(1.2) - (n % 40) / F.lit(100.0)).alias("discharges_multiplier"),
        (F.lit(0.5) + (n % 30) / F.lit(10.0)).alias("emergency_multiplier"),
        ((n % 21 - 10) / F.lit(20.0)).alias("outbreak_delta"),
        (n % 61 - 10).cast("double").alias("occupancy_delta"),
        (F.lit(6) + n % 163).cast("int").alias("duration_hours"),
    )


def _payload(keys: DataFrame, name, scenario_id) -> DataFrame:
    n = F.col("n")
    return keys.select(
        "facility_id",
        scenario_id.cast("bigint").alias("id"),
        name.alias("name"),
        F.concat(F.lit("observed load "), n.cast("string")).alias("description"),
        (F.lit(0.2) + n * 13 % 520 / F.lit(100.0)).alias("admissions_multiplier"),
        (F.lit(1.0) + (n % 7) / F.lit(10.0)).alias("discharges_multiplier"),
        (F.lit(0.5) + (n % 40) / F.lit(10.0)).alias("emergency_multiplier"),
        ((n % 21 - 10) / F.lit(10.0)).alias("outbreak_delta"),
        (n * 17 % 220 - 100).cast("double").alias("occupancy_delta"),
        (F.lit(2) + n * 11 % 175).cast("int").alias("duration_hours"),
    )


def daily_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.groupBy(_facility(), F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def scenario_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new scenario per facility and day; some break a bound."""
    name = F.concat(F.lit("surge "), F.date_format("day", "yyyy-MM-dd"))
    return _payload(daily_load(spark, sf_dir), name, F.lit(None))


def scenario_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes to the scenarios 3, 6, 9, 12 and 15 of each facility, one per event type."""
    events = table(spark, sf_dir, "events")
    number = F.array_position(F.array(*[F.lit(k) for k in DEPARTMENT_KEY_OF_EVENT]), F.col("event_type"))
    counted = events.groupBy(_facility(), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return _payload(counted, F.concat(F.lit("revised "), F.col("event_type")), number * 3)


def quietest_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(facility_id, name) of the scenario made from the day with the fewest events."""
    load = daily_load(spark, sf_dir).groupBy("facility_id").agg(F.min_by("day", F.struct("n", "day")).alias("day"))
    return load.select("facility_id", F.concat(F.lit("surge "), F.date_format("day", "yyyy-MM-dd")).alias("name"))


def order_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A setting per order status, written with every order."""
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("status."), F.col("o_orderstatus")).alias("key"),
        F.to_json(F.struct(F.col("o_orderkey").alias("order"))).alias("value"),
        F.col("o_orderdate").cast("timestamp").alias("updated_at"),
    )


def event_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A setting per facility and event type, written with every event."""
    return table(spark, sf_dir, "events").select(
        F.concat_ws(".", F.lit("last"), (F.col("user_id") % 4).cast("string"), F.col("event_type")).alias("key"),
        F.col("props").alias("value"),
        F.col("ts").cast("timestamp").alias("updated_at"),
    )


TIME_PATTERN_OF_FACILITY = {"0": "MM/dd/yyyy HH:mm", "1": "dd/MM/yyyy HH:mm:ss", "2": "yyyy/MM/dd HH:mm", "3": "MMM d, yyyy h:mm a"}


def event_exports(spark: SparkSession, sf_dir: str, spoiled: bool = False) -> str:
    """A folder with the events' encounters as CSV files, one for each facility, in the headers of some system and with a layout
    of times of their own. ``spoiled`` makes some admission times unreadable, of another layout, or empty."""
    rows = event_encounters(table(spark, sf_dir, "events"))

    def text(c: str):
        written = F.lit(None).cast("string")
        for facility, pattern in TIME_PATTERN_OF_FACILITY.items():
            written = F.when(F.col("facility_id") == facility, F.date_format(c, pattern)).otherwise(written)
        return written

    admission, number = text("admission_time"), F.col("patient_id").cast("bigint")
    if spoiled:
        admission = F.when(number % 19 == 0, "n/a").when(number % 29 == 0, "31/31/2024 99:00").when(number % 37 == 0, F.lit(None)).when(
            (number % 31 == 0) & (F.col("facility_id") == "0"), "25/12/2024 10:00").otherwise(admission)
    path = scratch_path(spark, "exports")
    rows.select(
        "facility_id", F.col("patient_id").alias("Encounter ID"), admission.alias("Admission Time"), text("discharge_time").alias("Departure-Time"),
        F.col("department").alias("Care Unit"), F.col("admission_type").alias("Visit Type"),
    ).repartition("facility_id").write.partitionBy("facility_id").option("header", True).csv(path)
    return path


def stray_encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' encounters, some of them dated millennia away, some with a discharge that stands for "still here"."""
    rows = event_encounters(table(spark, sf_dir, "events"))
    number = F.col("patient_id").cast("bigint")
    at = lambda text: F.lit(text).cast("timestamp")
    admission = F.when(number % 251 == 0, at("0202-01-02 03:00:00")).when(number % 241 == 0, at("9998-06-01 05:00:00")).otherwise(F.col("admission_time"))
    discharge = F.when(number % 41 == 0, at("9999-12-31 00:00:00")).otherwise(F.col("discharge_time"))
    return canonical_encounters(rows.withColumns({"admission_time": admission, "discharge_time": discharge}))
