"""Typed rows with a verdict: what an ingest accepts, and what it sets aside with a reason.

One pass writes both. The same pass counts, through ``DataFrame.observe``, so that no second reading is needed to know how
many rows were refused and why.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from bedtide.sources.readers import CORRUPT, FILE, canonical_encounters, canonical_readings

FAULTS = ("missing", "other layout", "unreadable")
REJECTED = "_rejected"


def staged(raw: DataFrame, kind: str) -> DataFrame:
    """Canonical rows of ``raw`` (``event`` or ``aggregate``) with ``reason``, NULL for accepted ones, ``record``, the refused row as
    delivered (the CSV text where its number of fields is wrong, else JSON), and ``_file``."""
    rows = raw if FILE in raw.columns else raw.withColumn(FILE, F.lit(None).cast("string"))
    rows = rows.withColumns({
        "_record": F.struct(*[F.col(f"`{c}`") for c in raw.columns if c not in (CORRUPT, FILE)]),
        "_text": F.col(CORRUPT) if CORRUPT in raw.columns else F.lit(None).cast("string"),
    })
    if kind == "event":
        typed = canonical_encounters(rows, (FILE, "_record", "_text", "admission_time_fault", "discharge_time_fault"))
        fault, name = F.col("admission_time_fault"), "admission_time"
    else:
        typed = canonical_readings(rows, (FILE, "_record", "_text", "timestamp_fault"))
        fault, name = F.col("timestamp_fault"), "timestamp"
    reason = F.concat(F.lit(f"{name}: "), fault)
    record = F.when(fault.isNotNull(), F.coalesce(F.col("_text"), F.to_json("_record")))
    return typed.withColumns({"reason": reason, "record": record}).drop("_record", "_text", f"{name}_fault")


def write_staged(staged: DataFrame, path: str) -> dict[str, int]:
    """Write accepted and refused rows side by side under ``path``; what was counted on the way: ``rows``, ``rejected`` and one
    number for each kind of fault (``discharge_<fault>`` for discharges, which are replaced by an estimate and no reason to refuse)."""
    seen = Observation()
    counts = [F.count(F.lit(1)).alias("rows"), F.count("reason").alias("rejected")]
    counts += [F.count_if(F.coalesce(F.endswith("reason", F.lit(f": {f}")), F.lit(False))).alias(f.replace(" ", "_")) for f in FAULTS]
    if "discharge_time_fault" in staged.columns:
        counts += [F.count_if(F.coalesce((F.col("discharge_time_fault") == f) & F.col("reason").isNull(), F.lit(False))).alias(f"discharge_{f}".replace(" ", "_")) for f in FAULTS]
    rows = staged.observe(seen, *counts).drop("discharge_time_fault")
    rows.withColumn(REJECTED, F.col("reason").isNotNull()).write.partitionBy(REJECTED).parquet(path)
    return {name: int(n or 0) for name, n in seen.get.items()}


def _read(spark: SparkSession, path: str, rejected: bool) -> DataFrame:
    return spark.read.parquet(path).where(F.col(REJECTED) == F.lit(rejected)).drop(REJECTED)


def accepted(spark: SparkSession, path: str) -> DataFrame:
    """The accepted rows, in canonical columns; only their part of the table is read."""
    return _read(spark, path, False).drop("reason", "record", FILE)


def quarantine(spark: SparkSession, path: str) -> DataFrame:
    """(file, reason, record) of the refused rows."""
    return _read(spark, path, True).select(F.col(FILE).alias("file"), "reason", "record")
