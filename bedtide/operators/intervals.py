"""How many intervals hold each point, joined by bins.

An interval is cut at the borders of bins of a fixed width: its two ends meet the points of their bins under a residual
predicate, and the bins it covers whole are covers. A run of covered bins, however long, is a handful of blocks of 1, 2, 4, 8...
bins (at most two of each size), which a point's bin meets through the blocks it lies in. A run from a to b is the run from a
to the next border of the largest blocks, less that from b: so runs are summed by where they begin, and make blocks afterwards.
Equal intervals are summed and written first, so that their source is read once; each then makes five rows at most, whatever its
length, summed map-side by bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bedtide import config as C
from bedtide.functions import scalar as S
from bedtide.session import materialise

LEVELS = 23  # blocks of up to 2^22 bins: with bins of a day, more than the years 1 to 9999
HOURS_OF_A_BIN = 24


def _bin(value: Column, width: int) -> Column:
    return F.floor(value / F.lit(width)).cast("bigint")


def _blocks(first: Column, last: Column) -> Column:
    """The blocks (level, block) whose bins are first, ..., last - 1; beyond the largest size, as many of those as it takes."""
    struct = lambda level, block: F.struct(level.cast("int").alias("level"), block.alias("block"))

    def edges(level: Column) -> tuple[Column, Column]:
        size = F.call_function("shiftleft", F.lit(1).cast("bigint"), level)
        return F.ceil(first / size).cast("bigint"), F.floor(last / size).cast("bigint")

    def odd_ends(level: Column) -> Column:
        low, high = edges(level)
        return F.array(F.when((low < high) & (F.pmod(low, F.lit(2)) == 1), struct(level, low)), F.when((low < high) & (F.pmod(high, F.lit(2)) == 1), struct(level, high - 1)))

    top = F.lit(LEVELS - 1)
    low, high = edges(top)
    largest = F.when(low < high, F.transform(F.sequence(low, high - 1), lambda block: struct(top, block)))
    ends = F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 2)), odd_ends)))
    return F.concat(ends, F.coalesce(largest, F.array().cast("array<struct<level:int,block:bigint>>")))


def interval_counts(intervals: DataFrame, points: DataFrame, keys: list[str], width: int) -> DataFrame:
    """(keys, at, n) for the distinct ``points`` (keys, at): the sum of ``n`` over the ``intervals`` (keys, low, high, n) of
    the same keys with low <= at < high; 0 where there is none. All are whole numbers; empty intervals hold nothing."""
    rows = materialise(intervals.where("low < high").groupBy(*keys, "low", "high").agg(F.sum("n").alias("n")))
    placed = rows.withColumns({"first": _bin(F.col("low"), width), "last": _bin(F.col("high") - 1, width)})
    some, whole, n = F.col("first") < F.col("last"), F.col("first") + 1 < F.col("last"), F.col("n")
    border = lambda c: (-_bin(-c, 1 << LEVELS - 1) * (1 << LEVELS - 1)).cast("bigint")
    part = lambda at, low, high, n: F.struct(at.alias("bin"), low.alias("low"), high.alias("high"), n.alias("n"))
    run = lambda low, high, n: part(F.lit(None).cast("bigint"), low, high, n)
    begin, end = F.col("first") + 1, F.col("last")
    parts = F.array_compact(F.array(
        part(F.col("first"), F.col("low"), F.least("high", begin * width), n),
        F.when(some, part(end, end * width, F.col("high"), n)),
        F.when(whole, run(begin, border(begin), n)),
        F.when(whole, run(end, border(end), -n)),
        F.when(whole & (border(begin) < border(end)), run(border(begin), border(end), n)),
    ))
    summed = placed.select(*keys, F.inline(parts)).groupBy(*keys, "bin", "low", "high").agg(F.sum("n").alias("n"))
    edges, runs = summed.where("bin is not null"), summed.where("bin is null and low < high")
    covers = runs.select(*keys, "n", F.inline(_blocks(F.col("low"), F.col("high"))))
    covers = covers.groupBy(*keys, "level", "block").agg(F.sum("n").alias("n"))
    asked = points.select(*keys, "at").distinct().withColumn("bin", _bin(F.col("at"), width))
    above = F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda level: F.struct(level.alias("level"), F.call_function("shiftright", F.col("bin"), level).alias("block")))
    bins = asked.select(*keys, "bin").distinct().select(*keys, "bin", F.inline(above))
    covered = bins.join(covers, [*keys, "level", "block"]).groupBy(*keys, "bin").agg(F.sum("n").alias("covered"))
    inside = (F.col("at") >= F.col("low")) & (F.col("at") < F.col("high"))
    held = asked.join(edges, [*keys, "bin"]).where(inside).groupBy(*keys, "bin", "at").agg(F.sum("n").alias("held"))
    zero = F.lit(0).cast("bigint")
    return asked.join(held, [*keys, "bin", "at"], "left").join(covered, [*keys, "bin"], "left").select(
        *keys, "at", (F.coalesce("held", zero) + F.coalesce("covered", zero)).alias("n"))


def occupancy_by_range_join(clean: DataFrame, width: int = HOURS_OF_A_BIN) -> DataFrame:
    """(facility_id, department, ts, occupied) of the hours in which a department is not empty, straight from the stays.

    The points are the hours of the facility's days on which any stay begins, lasts or ends.
    """
    hour = lambda c: F.floor(F.unix_seconds(c) / 3600).cast("bigint")
    stays = clean.select("facility_id", F.col("mapped_department").alias("department"), hour("admission_bucket").alias("low"), hour("discharge_bucket").alias("high"), F.lit(1).cast("bigint").alias("n"))
    span = stays.groupBy("facility_id").agg(_bin(F.min("low"), width).alias("first"), _bin(F.max("high") - 1, width).alias("last"))
    days = span.select("facility_id", F.explode(F.sequence("first", "last")).alias("day"))
    hours = days.select("facility_id", F.explode(F.sequence(F.col("day") * width, F.col("day") * width + width - 1)).alias("at"))
    points = hours.select("facility_id", "at", F.explode(F.array(*[F.lit(d) for d in C.DEPARTMENTS])).alias("department"))
    counted = interval_counts(stays, points, ["facility_id", "department"], width).where("n > 0")
    return counted.select("facility_id", "department", S.plus_hours(F.lit("1970-01-01").cast("timestamp"), F.col("at")).alias("ts"), F.col("n").cast("double").alias("occupied"))
