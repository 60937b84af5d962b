"""What is costly to compute is written once, and read by the passes that follow."""

import datetime

from pyspark.sql import functions as F

from bedtide.operators import intervals
from bedtide.sources import csvsplits, readers, timeformats


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_read_once_for_votes_and_times(spark):
    frame = spark.createDataFrame([("a", "13/02/2026"), ("a", "01/02/2026"), ("b", "02/13/2026"), ("b", "01/02/2026"), ("b", None)], "file string, t string")
    timed = timeformats.with_times(frame, ["t"], ["file"])
    assert "regexp" not in plan(timed) and "RLIKE" not in plan(timed)
    found = {(r.file, str(r.t)[:10], r.t_fault) for r in timed.collect()}
    assert found == {("a", "2026-02-13", None), ("a", "2026-02-01", None), ("b", "2026-02-13", None), ("b", "2026-01-02", None), ("b", "None", "missing")}


def test_records_of_a_file_are_cut_once(spark, tmp_path):
    (tmp_path / "some.csv").write_text('a,b\n1,x\n2,"y\nz"\n3,w\n')
    rows = csvsplits.read_quoted_csv(spark, str(tmp_path), ["a", "b"], "_corrupt_record", "_file")
    assert "MapInArrow" not in plan(rows)
    assert sorted((r.a, r.b) for r in rows.collect()) == [("1", "x"), ("2", "y\nz"), ("3", "w")]


def test_other_columns_are_not_carried_along(spark, tmp_path):
    (tmp_path / "some.csv").write_text("Admission Time,Note\n2026-01-02 03:00,long\n")
    rows = readers.read_encounters(spark, str(tmp_path))
    assert "Note" not in plan(rows) and rows.first().admission_time == datetime.datetime(2026, 1, 2, 3)


def test_figures_with_odd_blanks_are_read_alike(spark):
    plain, odd = "1/2/99 03:04", ["\t1/2/99 03:04\n", "1/2/99  03:04", " 1/2/99 03:04 ", "1/2/99 03:04\n"]
    rows = timeformats.with_times(spark.createDataFrame([(t,) for t in [plain, *odd]], "t string"), ["t"]).select(F.col("t").cast("string")).collect()
    assert {r.t for r in rows} == {"1999-01-02 03:04:00"}


def test_intervals_are_read_once_and_long_ones_cross_the_largest_blocks(spark):
    border = 24 << intervals.LEVELS - 1
    some = [("a", -30, 50, 2), ("a", border - 100, border + 100, 1), ("a", -border - 60, border * 2 + 60, 3), ("a", 5, 5, 9), ("b", 0, 24, 1), ("b", 0, 24, 4)]
    asked = [("a", at) for at in (-border - 61, -border - 60, -31, -30, 0, 49, 50, border - 100, border, border + 99, border + 100, border * 2 + 59, border * 2 + 60)] + [("b", 0), ("b", 23), ("b", 24)]
    source = spark.createDataFrame(some, "k string, low bigint, high bigint, m bigint").withColumn("n", F.hash("k") * 0 + F.col("m"))
    counted = intervals.interval_counts(source, spark.createDataFrame(asked, "k string, at bigint"), ["k"], 24)
    assert "hash(" not in plan(counted)
    assert {(r.k, r["at"]): r.n for r in counted.collect()} == {(k, at): sum(n for one, low, high, n in some if one == k and low <= at < high) for k, at in asked}
