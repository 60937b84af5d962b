import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bedtide import config as C
from bedtide.functions import scalar as S
from bedtide.operators import hourly
from bedtide.sources import columns, readers, sinks
from fixtures import counted, visit_rows, visits, visits_csv


def test_clean_name():
    assert columns.clean_name("  Admit Time (UTC) ") == "admit_time_utc"
    assert columns.clean_name("__ICU--Beds__") == "icu_beds"


def test_aliases_first_listed_wins_and_others_stay(spark):
    df = spark.createDataFrame([("u", "d", "x", "t")], ["Unit", "Department", "extra", "Admit Time"])
    out = columns.resolve_aliases(df, C.ENCOUNTER_ALIASES)
    assert out.columns == ["Unit", "department", "extra", "admission_time"]
    assert out.first().department == "d"


def test_aliases_last_duplicate_header_wins(spark):
    df = spark.createDataFrame([("a", "b")], ["Admission-Time", "admission_time"])
    out = columns.resolve_aliases(df, C.ENCOUNTER_ALIASES)
    assert out.first().admission_time == "b"


def test_sniffing():
    assert columns.sniff_kind(["Admission Time", "ward"]) == "event"
    assert columns.sniff_kind(["admission_type"]) == "event"
    assert columns.sniff_kind(["admit_time"]) == "aggregate"
    assert columns.sniff_kind(["admit_time"], kind="event") == "event"
    assert columns.sniff_kind(["timestamp", "admissions"]) == "aggregate"
    with pytest.raises(ValueError):
        columns.sniff_kind([], kind="other")


def test_required_columns(spark):
    with pytest.raises(ValueError, match="discharges, emergency_occupied, icu_occupied, pediatric_occupied, ward_occupied"):
        readers.canonical_readings(spark.createDataFrame([("1", "2")], ["timestamp", "admissions"]))
    with pytest.raises(ValueError, match="admission_time"):
        readers.canonical_encounters(spark.createDataFrame([("1",)], ["patient_id"]))


def test_defaults_and_rejects(spark):
    df = readers.canonical_encounters(spark.createDataFrame([("2026-01-01 10:00",), ("nonsense",), (None,)], ["admit_time"]))
    good, bad = readers.split_rejected(df, "admission_time")
    assert good.count() == 1 and bad.count() == 2
    row = good.first()
    assert (row.facility_id, row.department, row.admission_type, row.discharge_time) == ("f0", "general ward", "", None)


def test_numbers_are_coerced(spark):
    df = spark.createDataFrame([("7",), ("x",), (None,), ("NaN",), ("2.5",)], ["v"])
    assert [r.n for r in df.select(S.coerce_num(F.col("v")).alias("n")).collect()] == [7.0, 0.0, 0.0, 0.0, 2.5]


@pytest.mark.parametrize("department, kind, expected", [
    ("ICU", "Emergency", "emergency"),
    ("ICU", "Transfer", "icu"),
    ("Pediatric ICU", "Emergency", "pediatric"),
    ("NICU", "", "pediatric"),
    ("E.D.", "", "ward"),
    ("Main ED", "", "emergency"),
    ("ER-2", "", "emergency"),
    ("Cedar", "Scheduled", "ward"),
    ("Intensive-Care", "", "icu"),
    ("Critical care", "", "icu"),
    ("Casualty", "", "emergency"),
    ("Child Health", "ed", "pediatric"),
    ("", "", "ward"),
])
def test_department_mapping(spark, department, kind, expected):
    row = spark.range(1).select(S.map_department(F.lit(department), F.lit(kind)).alias("d")).first()
    assert row.d == expected


def test_urgency_switch(spark):
    kinds = ["Scheduled", "Transfer", "Observation", "Direct", "URGENT", "er", "Walk-in"]
    df = spark.createDataFrame([(k,) for k in kinds], ["k"])
    flags = lambda mode: [r.f for r in df.select(S.is_emergency_case(F.lit("ward"), F.col("k"), mode).alias("f")).collect()]
    assert flags("reference") == [True, True, True, False, True, True, False]
    assert flags("word") == [False, False, False, False, True, True, False]


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(
    st.floats(-2000, 2000, allow_nan=False).filter(lambda v: v == 0 or abs(v) > 0.01),
    st.integers(1, 4000).map(lambda n: n / 80),
    st.integers(1, 4000).map(lambda n: n / 16),
), min_size=20, max_size=60))
def test_rounding_is_that_of_the_binary_value(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    for digits in (0, 1, 2, 3):
        got = [r.x for r in df.select(S.round_binary(F.col("v"), digits).alias("x")).collect()]
        assert got == [float(round(v, digits)) for v in values]


def test_ceil_to_five(spark):
    peaks = [0.0, 42.9, 48.0, 100.0, None]
    df = spark.createDataFrame([(p,) for p in peaks], "p double")
    got = [r.c for r in df.select(S.capacity_of(F.col("p"), 48).alias("c")).collect()]
    assert got == [max(5, math.ceil(max(48, (p or 0) * 1.12) / 5.0) * 5) for p in peaks]


def test_csv_json_parquet_orc_give_the_same_encounters(spark, tmp_path):
    from_csv = readers.read_encounters(spark, visits_csv(tmp_path / "f.csv"))
    expected = sorted(map(str, visits(spark).drop("patient_id").collect()))
    assert sorted(map(str, from_csv.drop("patient_id").collect())) == expected
    raw = readers.read_raw(spark, str(tmp_path / "f.csv"))
    for fmt in ("json", "parquet", "orc"):
        raw.write.format(fmt).save(str(tmp_path / fmt))
        got = readers.read_encounters(spark, str(tmp_path / fmt), fmt).drop("patient_id")
        assert sorted(map(str, got.collect())) == expected
    kind, rows = readers.read_dataset(spark, str(tmp_path / "f.csv"))
    assert kind == "event" and rows.count() == 230
    with pytest.raises(ValueError):
        readers.read_raw(spark, "x", "xml")


def test_hourly_sink_and_loader(spark, tmp_path):
    fact = hourly.hourly_from_encounters(visits(spark, n=9).withColumn("facility_id", F.lit("007")))
    order = ["facility_id", "ts", *hourly.FLOWS, "outbreak_signal", *C.OCCUPANCY_COLUMNS, "total_occupied"]
    expected = sorted(map(str, fact.select(order).collect()))
    sinks.write_hourly(fact, str(tmp_path / "p"))
    assert sorted(map(str, readers.load_hourly(spark, str(tmp_path / "p")).select(order).collect())) == expected
    sinks.write_hourly(fact.drop("outbreak_signal", "total_occupied"), str(tmp_path / "c"), "csv")
    again = readers.load_hourly(spark, str(tmp_path / "c"), "csv").where("facility_id IS NOT NULL")
    assert again.count() == sum(1 for _ in counted(visit_rows(9)))
    total = again.agg(F.sum("total_occupied")).first()[0]
    assert total == sum(sum(w[4]) for w in counted(visit_rows(9)))
    sinks.write_raw(spark.range(3), str(tmp_path / "raw"), "a1")
    assert spark.read.parquet(str(tmp_path / "raw")).where("_ingest_id = 'a1'").count() == 3
