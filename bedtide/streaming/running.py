"""Occupancy as a stream: the running sums of closed hours, carried in keyed state.

State is one value a facility: the hour up to which its series is out, the beds in use then, and the arrivals and departures of
later hours, summed by hour. An arrival and its departure come in one row and are late together, so what is dropped
never leaves a bed in use for ever.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from bedtide import config as C
from bedtide.operators.stays import clean_encounters

HOUR_MS = 3_600_000
FLOWS = ["admissions", "discharges", "emergency_cases"]
WIDTH = len(FLOWS) + len(C.DEPARTMENTS)  # sums of an hour: the flows, and the change of each department
STATE = "until bigint, beds array<bigint>, hours array<bigint>, sums array<bigint>"
OUTPUT = "facility_id string, ts timestamp, " + ", ".join(f"{c} bigint" for c in FLOWS) + ", " + ", ".join(f"{c} double" for c in C.OCCUPANCY_COLUMNS)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EMITTED = 100_000  # rows handed over at a time


def summed(hours: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hours in order, each once, with the sums of its rows."""
    known, at = np.unique(hours, return_inverse=True)
    total = np.zeros((len(known), WIDTH), np.int64)
    np.add.at(total, at, sums)
    return known, total


def hourly_changes(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hours and sums of rows (department, admitted, discharged, n, emergencies), times in hours since 1970."""
    department = rows["department"].map({d: i for i, d in enumerate(C.DEPARTMENTS)}).to_numpy()
    n, line = rows["n"].to_numpy(np.int64), np.arange(len(rows))
    come, go = np.zeros((len(rows), WIDTH), np.int64), np.zeros((len(rows), WIDTH), np.int64)
    come[:, 0], come[:, 2], go[:, 1] = n, rows["emergencies"], n
    come[line, len(FLOWS) + department], go[line, len(FLOWS) + department] = n, -n
    return summed(np.concatenate([rows["admitted"], rows["discharged"]]).astype(np.int64), np.concatenate([come, go]))


class RunningOccupancy(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("series", STATE)

    def _load(self) -> tuple[int | None, np.ndarray, np.ndarray, np.ndarray]:
        if not self.state.exists():
            return None, np.zeros(len(C.DEPARTMENTS), np.int64), np.zeros(0, np.int64), np.zeros((0, WIDTH), np.int64)
        until, beds, hours, sums = self.state.get()
        return until, np.array(beds, np.int64), np.array(hours, np.int64), np.array(sums, np.int64).reshape(-1, WIDTH)

    def _advance(self, key, until, beds, hours, sums, watermark: int) -> Iterator[pd.DataFrame]:
        """Emit the hours before ``watermark`` and keep the rest."""
        if until is None:
            until = int(hours[0])
        closed = max(until, -(-watermark // HOUR_MS))
        for first in range(until, closed, EMITTED):
            last = min(closed, first + EMITTED)
            here = (hours >= first) & (hours < last)
            table = np.zeros((last - first, WIDTH), np.int64)
            table[hours[here] - first] = sums[here]
            running = beds + np.cumsum(table[:, len(FLOWS):], axis=0)
            beds = running[-1]
            yield pd.DataFrame({
                "facility_id": key[0], "ts": pd.to_datetime(np.arange(first, last) * HOUR_MS, unit="ms"),
                **{c: table[:, i] for i, c in enumerate(FLOWS)}, **{c: np.maximum(running[:, i], 0).astype(float) for i, c in enumerate(C.OCCUPANCY_COLUMNS)},
            })
        rest = hours >= closed
        self.state.update((closed, beds.tolist(), hours[rest].tolist(), sums[rest].ravel().tolist()))
        self.handle.registerTimer(closed * HOUR_MS + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        until, beds, hours, sums = self._load()
        for part in rows:
            more = hourly_changes(part)
            hours, sums = summed(np.concatenate([hours, more[0]]), np.concatenate([sums, more[1]]))
        yield from self._advance(key, until, beds, hours, sums, max(0, timerValues.getCurrentWatermarkInMs()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, *self._load(), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def stream_hourly_occupancy(encounters: DataFrame, stays: DataFrame, urgency: str = "reference", delay: str = "2 hours") -> DataFrame:
    """(facility_id, ts, flows, occupancies) of every closed hour of a streaming encounter table, in append mode.

    An hour is closed when the watermark, the latest admission less ``delay``, has passed its beginning. A stay admitted in a
    closed hour comes too late: it is dropped whole, and counted in the query's progress. Rows are summed by facility, department and
    hours within each partition before they are sent to their facility. Start the query with ``run_occupancy``.
    """
    clean = clean_encounters(encounters, urgency, stays)
    hour = lambda c: F.floor(F.unix_seconds(c) / 3600).cast("bigint")
    rows = clean.select(
        "facility_id", F.col("mapped_department").alias("department"), hour("admission_bucket").alias("admitted"), hour("discharge_bucket").alias("discharged"),
        F.col("is_emergency").cast("bigint").alias("emergencies"), F.lit(1).cast("bigint").alias("n"))

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.groupby(["facility_id", "department", "admitted", "discharged"], as_index=False)[["emergencies", "n"]].sum()

    parts = rows.mapInPandas(combine, "facility_id string, department string, admitted bigint, discharged bigint, emergencies bigint, n bigint")
    timed = parts.withColumn("ts", F.timestamp_seconds(F.col("admitted") * 3600)).withWatermark("ts", delay)
    return timed.groupBy("facility_id").transformWithStateInPandas(RunningOccupancy(), OUTPUT, "Append", "EventTime")


def run_occupancy(occupancy: DataFrame, path: str, checkpoint: str, restarts: int = 1) -> StreamingQuery:
    """Process what is there and write closed hours as Parquet; the finished query, whose progress counts the late rows.

    A query that fails is started again from its checkpoint, ``restarts`` times; no hour is lost or written twice by that. Keyed state of this kind needs the RocksDB store; the session's own choice is put back once the query runs.
    """
    conf, key = occupancy.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key, None)
    conf.set(key, ROCKS)
    try:
        for left in range(restarts, -1, -1):
            query = occupancy.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
            try:
                query.awaitTermination()
                break
            except StreamingQueryException:
                if not left:
                    raise
    finally:
        conf.unset(key) if before is None else conf.set(key, before)
    return query


def late_rows(query: StreamingQuery) -> int:
    """Rows, as summed before the shuffle, that came after their hour was closed."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
