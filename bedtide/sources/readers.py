"""Readers that turn raw files or tables into the two canonical inputs, and the normalised hourly table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bedtide import config as C
from bedtide.functions import scalar as S
from bedtide.session import utc
from bedtide.sources.columns import require_columns, resolve_aliases, sniff_kind, with_defaults
from bedtide.sources.csvsplits import read_quoted_csv
from bedtide.sources.timeformats import with_times

CORRUPT, FILE = "_corrupt_record", "_file"


def read_raw(spark: SparkSession, path: str, fmt: str = "csv", multiline: bool = True, with_file: bool = False, split: bool = True) -> DataFrame:
    """Raw columns: CSV and JSON values stay text, Parquet and ORC keep their types.

    CSV columns are those of the header, all text, with the whole record beside them where its number of fields
    is another one. Quoted fields may hold line breaks; files are read in byte ranges all the same. ``split=False`` reads each
    whole by one task instead, with Spark's own reader; ``multiline=False`` takes every line for a record.
    ``with_file`` adds the file of each row as ``_file``.
    """
    utc(spark)
    if fmt == "csv":
        reader = lambda: spark.read.options(header=True, multiLine=multiline, quote='"', escape='"', mode="PERMISSIVE")
        names = reader().csv(path).columns
        if multiline and split:
            rows = read_quoted_csv(spark, path, names, CORRUPT, FILE)
            return rows if with_file else rows.drop(FILE)
        schema = T.StructType([*(T.StructField(name, T.StringType()) for name in names), T.StructField(CORRUPT, T.StringType())])
        rows = reader().option("columnNameOfCorruptRecord", CORRUPT).option("enforceSchema", False).schema(schema).csv(path)
        return rows.select("*", F.col("_metadata.file_path").alias(FILE)) if with_file else rows
    if with_file:
        return read_raw(spark, path, fmt).select("*", F.col("_metadata.file_path").alias(FILE))
    if fmt == "json":
        return spark.read.option("primitivesAsString", True).option("columnNameOfCorruptRecord", CORRUPT).json(path)
    if fmt in ("parquet", "orc"):
        return spark.read.format(fmt).load(path)
    raise ValueError(f"Unknown source format: {fmt}")


def _as_ts(df: DataFrame, column: str):
    """Typed timestamps pass, zone-less ones are taken as UTC, text is parsed."""
    kind = dict(df.dtypes)[column]
    return F.col(column).cast("timestamp") if kind.startswith("timestamp") or kind == "date" else S.coerce_ts(F.col(column))


def _timed(df: DataFrame, columns: list[str], keep: tuple[str, ...], wanted: list[str]) -> DataFrame:
    """``columns`` as timestamps beside what is ``wanted`` or to ``keep``, and their faults where ``keep`` names them. Typed ones pass, zone-less ones are taken as UTC; text is read
    as its file's rows vote, or month first where the files aren't known."""
    kinds = dict(df.dtypes)
    text = [c for c in columns if not kinds[c].startswith("timestamp") and kinds[c] != "date"]
    if text:
        df = df.select(*(f"`{c}`" for c in df.columns if c in (*wanted, *columns, *keep, FILE)))
        df = with_times(df, text, [FILE] if FILE in df.columns and not df.isStreaming else None)
    typed = {c: F.col(c).cast("timestamp") for c in columns if c not in text}
    faults = {f"{c}_fault": F.when(F.col(c).isNull(), "missing") for c in typed if f"{c}_fault" in keep}
    return df.withColumns(typed | faults)


def canonical_encounters(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Any encounter table to the canonical encounter columns; unreadable admissions stay, as NULL.

    ``keep`` names further columns to leave beside them, ``admission_time_fault`` and ``discharge_time_fault`` among them.
    """
    df = resolve_aliases(df, C.ENCOUNTER_ALIASES)
    if "admission_time" not in df.columns:
        raise ValueError("Encounter dataset requires an admission_time column.")
    df = with_defaults(df, {
        "facility_id": C.DEFAULT_FACILITY, "patient_id": None, "discharge_time": None,
        "department": C.DEFAULT_DEPARTMENT_TEXT, "admission_type": "",
    })
    wanted = ["facility_id", "patient_id", "department", "admission_type"]
    return _timed(df, ["admission_time", "discharge_time"], keep, wanted).select(
        F.col("facility_id").cast("string").alias("facility_id"),
        F.col("patient_id").cast("string").alias("patient_id"),
        "admission_time", "discharge_time",
        F.coalesce(F.col("department").cast("string"), F.lit(C.DEFAULT_DEPARTMENT_TEXT)).alias("department"),
        F.coalesce(F.col("admission_type").cast("string"), F.lit("")).alias("admission_type"), *keep,
    )


def canonical_readings(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Any reading table to the canonical reading columns.

    ``outbreak_given`` tells whether the source had the column at all, see ``hourly_from_readings``. ``keep`` names further
    columns to leave beside them, ``timestamp_fault`` among them.
    """
    df = resolve_aliases(df, C.READING_ALIASES)
    require_columns(df, ["timestamp", "admissions", "discharges", *C.OCCUPANCY_COLUMNS], "Aggregate dataset")
    given = "outbreak_signal" in df.columns
    df = with_defaults(df, {"facility_id": C.DEFAULT_FACILITY, "emergency_cases": "0", "outbreak_signal": "0"})
    numbers = ["admissions", "discharges", "emergency_cases", "outbreak_signal", *C.OCCUPANCY_COLUMNS]
    return _timed(df, ["timestamp"], keep, ["facility_id", *numbers]).select(
        F.col("facility_id").cast("string").alias("facility_id"),
        F.col("timestamp").alias("ts"),
        *[S.coerce_num(F.col(c)).alias(c) for c in numbers],
        F.lit(given).alias("outbreak_given"), *keep,
    )


def too_many_fields(raw: DataFrame) -> DataFrame:
    """Records of a CSV table with more fields than its header: reading them would lose the last ones."""
    if CORRUPT not in raw.columns:
        return raw.limit(0).select(F.lit(None).cast("string").alias("record"))
    fields = F.split(F.col(CORRUPT), ',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)
    header = [c for c in raw.columns if c not in (CORRUPT, FILE)]
    return raw.where(F.col(CORRUPT).isNotNull() & (F.size(fields) > len(header))).select(F.col(CORRUPT).alias("record"))


def split_rejected(df: DataFrame, time_column: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a usable time, rows without one)."""
    return df.where(F.col(time_column).isNotNull()), df.where(F.col(time_column).isNull())


def read_encounters(spark: SparkSession, path: str, fmt: str = "csv", **options) -> DataFrame:
    """Encounters of a file or folder; times are read as each file's rows vote."""
    return canonical_encounters(read_raw(spark, path, fmt, with_file=True, **options))


def read_readings(spark: SparkSession, path: str, fmt: str = "csv", **options) -> DataFrame:
    return canonical_readings(read_raw(spark, path, fmt, with_file=True, **options))


def read_dataset(spark: SparkSession, path: str, fmt: str = "csv", kind: str | None = None, **options) -> tuple[str, DataFrame]:
    """Sniff the kind of a file and return (kind, canonical rows)."""
    raw = read_raw(spark, path, fmt, with_file=True, **options)
    kind = sniff_kind(raw.columns, kind)
    return kind, canonical_encounters(raw) if kind == "event" else canonical_readings(raw)


def total_occupied():
    """Sum over departments, an unknown one counts as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) for c in C.OCCUPANCY_COLUMNS])


def load_hourly(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """An hourly table written earlier. The signal is derived where the file has none; the total always is."""
    from bedtide.operators.signal import with_outbreak_signal

    raw = read_raw(spark, path, fmt)
    if "ts" not in raw.columns and "timestamp" in raw.columns:
        raw = raw.withColumnRenamed("timestamp", "ts")
    raw = with_defaults(raw, {"facility_id": C.DEFAULT_FACILITY})
    require_columns(raw, ["ts", "admissions", "discharges", "emergency_cases", *C.OCCUPANCY_COLUMNS], "Hourly dataset")
    kinds = dict(raw.dtypes)
    given = [c for c in ["outbreak_signal"] if c in raw.columns]
    numbers = ["admissions", "discharges", "emergency_cases", *given, *C.OCCUPANCY_COLUMNS]
    df = raw.select(
        F.col("facility_id").cast("string").alias("facility_id"),
        _as_ts(raw, "ts").alias("ts"),
        *[F.col(c).try_cast("double").alias(c) if kinds[c] == "string" else F.col(c) for c in numbers],
    )
    if not given:
        df = with_outbreak_signal(df)
    return df.withColumn("total_occupied", total_occupied())
