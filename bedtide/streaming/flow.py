"""Structured Streaming: hourly flows from an encounter stream, alerts into the history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bedtide.operators import state
from bedtide.operators.stays import clean_encounters


def stream_hourly_flow(
    encounters: DataFrame,
    stays: DataFrame,
    urgency: str = "reference",
    admission_delay: str = "2 hours",
    discharge_delay: str = "2 hours",
) -> DataFrame:
    """Hourly admissions, discharges and emergencies of a streaming encounter table, in append mode.

    Arrivals and departures are two event-time streams of their own, each with its watermark; the union
    advances with the slower one. Hours are emitted once closed, so the last open hours are held back.
    Default stays come from a batch over past encounters. State is one row per facility and open hour.
    """
    clean = clean_encounters(encounters, urgency, stays)
    one = F.lit(1).cast("bigint")
    none = F.lit(0).cast("bigint")
    arrivals = clean.select(
        "facility_id", F.col("admission_bucket").alias("ts"),
        one.alias("starts"), none.alias("ends"), F.col("is_emergency").cast("bigint").alias("emergencies"),
    ).withWatermark("ts", admission_delay)
    departures = clean.select(
        "facility_id", F.col("discharge_bucket").alias("ts"),
        none.alias("starts"), one.alias("ends"), none.alias("emergencies"),
    ).withWatermark("ts", discharge_delay)
    return (
        arrivals.unionByName(departures)
        .groupBy("facility_id", F.window("ts", "1 hour").alias("hour"))
        .agg(
            F.sum("starts").alias("admissions"),
            F.sum("ends").alias("discharges"),
            F.sum("emergencies").alias("emergency_cases"),
        )
        .select("facility_id", F.col("hour.start").alias("ts"), "admissions", "discharges", "emergency_cases")
    )


def run_available(flow: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process what is there, write closed hours as Parquet, return them."""
    query = (
        flow.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(path)
    )
    query.awaitTermination()
    return flow.sparkSession.read.schema(flow.schema).parquet(path)


def alert_sink(alerts: DataFrame, root: str, checkpoint: str, now: str, compact_every: int = 50) -> StreamingQuery:
    """Upsert a stream of history rows, batch by batch. A batch that is retried finds its alerts known and
    leaves the same history. Every ``compact_every`` batches the history becomes a snapshot."""
    spark = alerts.sparkSession
    state.create_log(spark, root, "alert_history")

    def upsert(batch: DataFrame, number: int) -> None:
        existing = state.read_state(batch.sparkSession, root, "alert_history")
        state.append_log(state.alert_changes(existing, batch), root, "alert_history", now)
        if number % compact_every == compact_every - 1:
            state.compact(batch.sparkSession, root, "alert_history")

    return (
        alerts.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
