"""Interval counts, spans, sketches, roll-ups, snapshots and the running stream against plain versions."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from bedtide import config as C
from bedtide.operators import hourly, intervals, kpis, span, state, stays
from bedtide.streaming import running


@pytest.mark.parametrize("width", [1, 7, 24])
def test_interval_counts(spark, width):
    rng = np.random.default_rng(width)
    rows = [(str(k), int(a), int(a + d), int(n)) for k, a, d, n in zip(rng.integers(0, 3, 300), rng.integers(-500, 500, 300), rng.integers(-2, 400, 300), rng.integers(1, 4, 300))]
    rows += [("0", -5_000_000, 80_000_000, 1), ("0", 3, 3, 9), ("0", 3, 4, 1), ("0", 3, 4, 1), ("9", 0, 10, 1)]
    points = [(str(k), int(a)) for k in range(4) for a in range(-600, 950, 3)] + [("0", 79_999_999), ("0", 80_000_000), ("0", -5_000_000), ("0", 0), ("0", 0)]
    frame = spark.createDataFrame(rows, "k string, low bigint, high bigint, n bigint")
    got = intervals.interval_counts(frame, spark.createDataFrame(points, "k string, at bigint"), ["k"], width).collect()
    want = {(k, t): sum(n for g, a, b, n in rows if g == k and a <= t < b) for k, t in points}
    assert {(r.k, r["at"]): r.n for r in got} == want and len(got) == len(want)


def test_blocks_cover_every_bin_once(spark):
    rows = [(a, b) for a in range(-9, 20) for b in range(a + 1, 40)]
    found = spark.createDataFrame(rows, "a bigint, b bigint").select("a", "b", intervals._blocks(F.col("a"), F.col("b")).alias("x")).collect()
    for r in found:
        bins = [i for block in r.x for i in range(block.block << block.level, (block.block + 1) << block.level)]
        assert sorted(bins) == list(range(r.a, r.b)) and len(r.x) <= 2 * 6


def at(text):
    return datetime.datetime.fromisoformat(text)


def test_spans(spark):
    rows = [("a", at("2024-01-01 05:00:00"), at("2024-01-02 05:00:00"))] * 3 + [("a", at("2024-12-30 05:00:00"), None), ("a", at("0202-01-01 00:00:00"), None), ("a", at("2024-01-05 00:00:00"), at("9999-12-31 00:00:00")),
            ("b", at("2020-01-01 00:00:00"), None), ("b", at("2024-01-01 00:00:00"), None), ("c", None, at("2024-01-01 00:00:00"))]
    frame = spark.createDataFrame(rows, "facility_id string, admission_time timestamp, discharge_time timestamp")
    spans = span.main_spans(frame)
    assert {r.facility_id: (str(r.first_day), str(r.last_day)) for r in spans.collect()} == {"a": ("2024-01-01", "2024-12-30"), "b": ("2024-01-01", "2024-01-01")}
    kept = span.within_span(frame, spans).collect()
    assert len(kept) == 7 and sum(r.facility_id == "a" and r.discharge_time is None for r in kept) == 2
    assert sorted((r.facility_id, r.issue, r.rows) for r in span.span_issues(frame, spans).collect()) == [("a", "admission outside span", 1), ("a", "discharge outside span", 1), ("b", "admission outside span", 1)]
    assert span.main_spans(frame.limit(0)).count() == 0 and span.within_span(frame.limit(0), spans).count() == 0


def test_gaps_are_filled_by_day_and_hour(spark):
    rows = [("a", at("2024-01-01 22:00:00"), 1, 5.0), ("a", at("2024-01-01 23:00:00"), 2, 6.0), ("a", at("2024-01-04 01:00:00"), 3, 7.0), ("b", at("2024-02-28 12:00:00"), 4, 8.0), ("b", at("2024-03-01 00:00:00"), 5, 9.0)]
    filled = hourly.fill_hours(spark.createDataFrame(rows, "facility_id string, ts timestamp, n bigint, level double"), ["n"], ["level"], "carry").orderBy("facility_id", "ts").collect()
    for name, first, last in (("a", rows[0][1], rows[2][1]), ("b", rows[3][1], rows[4][1])):
        mine = [r for r in filled if r.facility_id == name]
        assert [r.ts for r in mine] == [first + datetime.timedelta(hours=h) for h in range(int((last - first).total_seconds() // 3600) + 1)]
        assert sum(r.n for r in mine) == sum(r[2] for r in rows if r[0] == name) and mine[-2].level == [r[3] for r in rows if r[0] == name][-2]


def test_sketch(spark):
    rng = np.random.default_rng(0)
    rows = [("a", int(x)) for x in rng.lognormal(10, 2, 20000)] + [("b", 5)] * 7 + [("c", 0)]
    lengths = spark.createDataFrame(rows, "facility_id string, los bigint")
    medians = stays.sketched_median_stays(lengths)
    errors = {r.facility_id: r.rank_error for r in stays.rank_errors(lengths, medians).collect()}
    assert errors["a"] <= 0.02 and errors["b"] == errors["c"] == 0
    wrong = spark.createDataFrame([("a", 0.0)], "facility_id string, median_micros double")
    assert stays.rank_errors(lengths, wrong).first().rank_error == pytest.approx(0.5)
    with pytest.raises(ValueError, match="Unknown method"):
        stays.default_stays(lengths, "guess")


def clean(spark, rows):
    return spark.createDataFrame(rows, "facility_id string, mapped_department string, admission_bucket timestamp, discharge_bucket timestamp, is_emergency boolean")


def stays_of(seed, n=400):
    rng = np.random.default_rng(seed)
    start = at("2024-03-01 00:00:00")
    out = []
    for _ in range(n):
        first = start + datetime.timedelta(hours=int(rng.integers(0, 500)))
        out.append((str(rng.integers(0, 3)), str(rng.choice(C.DEPARTMENTS)), first, first + datetime.timedelta(hours=int(rng.integers(1, 200))), bool(rng.integers(0, 2))))
    return out


def test_range_join_equals_running_sum(spark):
    frame = clean(spark, stays_of(4))
    want = {(r.facility_id, r.department, r.ts): r.occupied for r in hourly.by_department(hourly.hourly_occupancy(frame)).collect() if r.occupied}
    assert {(r.facility_id, r.department, r.ts): r.occupied for r in intervals.occupancy_by_range_join(frame).collect()} == want


def test_rollup(spark):
    hours = hourly.hourly_occupancy(clean(spark, stays_of(5))).withColumn("outbreak_signal", F.lit(0.0))
    rows = kpis.overview_rollup(hours).collect()
    parts = {(r.facility_id, r.department): r for r in rows}
    assert [sum(r.level == x for r in rows) for x in ("department", "facility", "network")] == [12, 3, 1]
    for name in "012":
        assert parts[name, None].capacity == sum(parts[name, d].capacity for d in C.DEPARTMENTS)
        assert parts[name, None].occupied == pytest.approx(sum(parts[name, d].occupied for d in C.DEPARTMENTS))
    assert parts[None, None].capacity == sum(parts[n, None].capacity for n in "012")


def test_snapshot(spark, tmp_path):
    root = str(tmp_path)
    state.create_log(spark, root, "settings")
    put = lambda k, v, **o: state.append_log(spark.createDataFrame([(k, v, None)], "key string, value string, updated_at timestamp"), root, "settings", "2024-01-01 00:00:00", **o)
    read = lambda: {r.key: r.value for r in state.read_state(spark, root, "settings").collect()}
    put("a", "1"), put("b", "1"), put("a", "2"), put("c", "1"), put("c", "1", deleted=True)
    before = read()
    assert state.compact(spark, root, "settings") == 1 and read() == before == {"a": "2", "b": "1"}
    assert state.read_tail(spark, root, "settings").isEmpty() and state.next_sequence(spark, root, "settings") == 6
    put("a", "3"), put("c", "2"), put("a", "3")
    assert read() == {"a": "3", "b": "1", "c": "2"} and state.read_tail(spark, root, "settings").count() == 3
    assert state.read_log(spark, root, "settings").count() == 6
    # A compaction that broke off before its pointer leaves the state as it is, and the next one overwrites it.
    spark.createDataFrame([], "key string").write.parquet(f"{root}/settings/snapshot-2")
    assert read() == {"a": "3", "b": "1", "c": "2"}
    assert state.compact(spark, root, "settings") == 2 and read() == {"a": "3", "b": "1", "c": "2"}
    put("b", "1", deleted=True)
    assert read() == {"a": "3", "c": "2"}
    state.create_log(spark, root, "settings")
    assert read() == {"a": "3", "c": "2"}


def test_running_stream(spark, tmp_path):
    """Days in files of their own, the last of them with rows from the beginning: closed hours equal the batch without those."""
    rng = np.random.default_rng(7)
    start, rows = at("2024-03-01 00:00:00"), []
    for i in range(600):
        first = start + datetime.timedelta(minutes=int(rng.integers(0, 10 * 24 * 60)))
        rows.append((str(i % 2), str(i), first, first + datetime.timedelta(hours=int(rng.integers(1, 60))), str(rng.choice(["ICU", "ward", "child", "trauma"])), "Emergency" if i % 3 else "Planned"))
    schema = "facility_id string, patient_id string, admission_time timestamp, discharge_time timestamp, department string, admission_type string"
    late = [(f, f"late{i}", start, start + datetime.timedelta(days=30), "ICU", "Planned") for i, f in enumerate("01")]
    for day in range(10):
        some = [r for r in rows if (r[2] - start).days == day] + (late if day == 9 else [])
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    whole = spark.createDataFrame(rows, schema)
    default = stays.default_stays(whole)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    closed = running.stream_hourly_occupancy(stream, default)
    query = running.run_occupancy(closed, str(tmp_path / "out"), str(tmp_path / "log"))
    got = {(r.facility_id, r.ts): tuple(r)[2:] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    mark = max(r[2] for r in rows).replace(minute=0, second=0) - datetime.timedelta(hours=2)
    batch = hourly.hourly_occupancy(stays.clean_encounters(whole, stays=default)).where(F.col("ts") < F.lit(mark))
    want = {(r.facility_id, r.ts): tuple(r[c] for c in [*running.FLOWS, *C.OCCUPANCY_COLUMNS]) for r in batch.collect()}
    assert got == want and running.late_rows(query) == 2
