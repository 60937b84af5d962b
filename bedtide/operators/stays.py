"""Encounter cleaning: default stay per facility, discharge imputation, hour buckets, department mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bedtide import config as C
from bedtide.functions import scalar as S
from bedtide.session import materialise

# Width of the coarse length-of-stay bucket used by the exact median: 2^24 microseconds, about 17 seconds.
COARSE_BITS = 24
SKETCH_SIZE = 800  # lengths a level of a quantile sketch; the rank error is then about 0.6 %


def stay_lengths(encounters: DataFrame) -> DataFrame:
    """(facility_id, los) in microseconds for encounters with both times, zero and negative stays included."""
    return (
        encounters.where("admission_time IS NOT NULL AND discharge_time IS NOT NULL")
        .select("facility_id", (F.unix_micros("discharge_time") - F.unix_micros("admission_time")).alias("los"))
    )


def _running_counts(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    before = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))


def _holds(rank: str):
    return (F.col("before") < F.col(rank)) & (F.col(rank) <= F.col("before") + F.col("n"))


def median_stays(lengths: DataFrame) -> DataFrame:
    """Exact median per facility: (facility_id, median_micros, any_nonzero).

    ``median()`` would gather every distinct length of a facility in one task. Instead a histogram over
    coarse buckets finds the bucket of each middle rank; where that bucket holds more than one length, a
    second one over its single microseconds finds the value. Both aggregate map-side first, and what a
    facility brings to one task is bounded by the number of buckets, however many encounters it has.
    Lengths recorded to the minute never need the second pass.
    """
    bucketed = lengths.withColumn("bucket", F.shiftright("los", COARSE_BITS))
    histogram = bucketed.groupBy("facility_id", "bucket").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.col("los") != 0).alias("nonzero"),
        F.min("los").alias("shortest"),
        F.max("los").alias("longest"),
    )
    whole = Window.partitionBy("facility_id")
    ranked = (
        _running_counts(histogram, ["facility_id"], "bucket")
        .withColumn("total", F.sum("n").over(whole))
        .withColumn("any_nonzero", F.max("nonzero").over(whole))
        .withColumn("low_rank", F.floor((F.col("total") + 1) / 2))
        .withColumn("high_rank", F.floor(F.col("total") / 2) + 1)
    )
    middle = materialise(
        ranked.where(_holds("low_rank") | _holds("high_rank")).select(
            "facility_id", "bucket", "any_nonzero", "shortest", "longest",
            F.when(_holds("low_rank"), F.col("low_rank") - F.col("before")).alias("low_rank"),
            F.when(_holds("high_rank"), F.col("high_rank") - F.col("before")).alias("high_rank"),
        )
    )
    settled = middle.where("shortest = longest").select(
        "facility_id", "any_nonzero",
        F.when(F.col("low_rank").isNotNull(), F.col("shortest")).alias("low"),
        F.when(F.col("high_rank").isNotNull(), F.col("shortest")).alias("high"),
    )
    unsettled = middle.where("shortest <> longest").drop("shortest", "longest")
    if not unsettled.isEmpty():
        inside = bucketed.join(unsettled, ["facility_id", "bucket"]).groupBy(
            "facility_id", "bucket", "los", "any_nonzero", "low_rank", "high_rank"
        ).agg(F.count(F.lit(1)).alias("n"))
        found = _running_counts(inside, ["facility_id", "bucket"], "los").select(
            "facility_id", "any_nonzero",
            F.when(_holds("low_rank"), F.col("los")).alias("low"),
            F.when(_holds("high_rank"), F.col("los")).alias("high"),
        )
        settled = settled.unionByName(materialise(found.where("low IS NOT NULL OR high IS NOT NULL")))
    return (
        settled.groupBy("facility_id")
        .agg(F.max("low").alias("low"), F.max("high").alias("high"), F.max("any_nonzero").alias("any_nonzero"))
        .select("facility_id", ((F.col("low") + F.col("high")) / 2).alias("median_micros"), "any_nonzero")
    )


def sketched_median_stays(lengths: DataFrame, k: int = SKETCH_SIZE) -> DataFrame:
    """The median per facility from one mergeable quantile sketch, in one pass: (facility_id, median_micros, any_nonzero).

    A sketch keeps some ``k`` lengths a level, however many it has seen; the rank of what it returns is off by a share of
    about 2.3 / k^0.9 of the rows.
    """
    return lengths.groupBy("facility_id").agg(F.kll_sketch_agg_bigint("los", k).alias("sketch"), F.max(F.col("los") != 0).alias("any_nonzero")).select(
        "facility_id", F.kll_sketch_get_quantile_bigint("sketch", F.lit(0.5)).cast("double").alias("median_micros"), "any_nonzero")


def rank_errors(lengths: DataFrame, medians: DataFrame) -> DataFrame:
    """(facility_id, rows, rank_error): how far the rank of each facility's ``median_micros`` is from the middle, as a share of
    its rows; 0 where the middle lies among equal lengths."""
    rows = lengths.join(medians.select("facility_id", "median_micros"), "facility_id")
    counted = rows.groupBy("facility_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("los") < F.col("median_micros")).alias("below"), F.count_if(F.col("los") <= F.col("median_micros")).alias("up_to"))
    outside = F.greatest(F.lit(0.0), F.col("below") / F.col("rows") - 0.5, F.lit(0.5) - F.col("up_to") / F.col("rows"))
    return counted.select("facility_id", "rows", outside.alias("rank_error"))


def default_stays(encounters: DataFrame, method: str = "exact") -> DataFrame:
    """(facility_id, default_stay_hours, default_stay_micros): the median stay, 36 h when no stay is
    non-zero, never under 12 h. Half microseconds go up, which leaves the hour buckets unchanged.

    ``method="sketch"`` takes the median from a quantile sketch instead, in a single pass."""
    if method not in ("exact", "sketch"):
        raise ValueError(f"Unknown method: {method}")
    medians = median_stays if method == "exact" else sketched_median_stays
    hour = float(S.MICROS_PER_HOUR)
    stay = F.greatest(
        F.lit(C.MIN_STAY_HOURS * hour),
        F.when(F.col("any_nonzero"), F.col("median_micros")).otherwise(F.lit(C.DEFAULT_STAY_HOURS * hour)),
    )
    return medians(stay_lengths(encounters)).select(
        "facility_id",
        (stay / F.lit(hour)).alias("default_stay_hours"),
        F.ceil(stay).cast("bigint").alias("default_stay_micros"),
    )


def clean_encounters(encounters: DataFrame, urgency: str = "reference", stays: DataFrame | None = None) -> DataFrame:
    """Canonical encounters to bucketed stays, one row in and one row out for every readable admission.

    A facility none of whose encounters has a discharge gets the 36 h default. The default stays come from
    a small written table, so the optimizer knows their size when it plans the join: encounters are not
    shuffled unless there are too many facilities to broadcast.
    """
    if stays is None:
        stays = default_stays(encounters)
    fallback = int(C.DEFAULT_STAY_HOURS * S.MICROS_PER_HOUR)
    readable = encounters.where(F.col("admission_time").isNotNull())
    imputed = F.col("discharge_time").isNull() | (F.col("discharge_time") <= F.col("admission_time"))
    joined = readable.join(stays.select("facility_id", "default_stay_micros"), "facility_id", "left")
    discharge = F.when(
        imputed, S.plus_micros(F.col("admission_time"), F.coalesce(F.col("default_stay_micros"), F.lit(fallback)))
    ).otherwise(F.col("discharge_time"))
    first, last = F.col("admission_bucket"), S.ceil_hour(F.col("discharge_time"))
    return (
        joined.withColumns({
            "discharge_imputed": F.coalesce(imputed, F.lit(True)),
            "discharge_time": discharge,
            "mapped_department": S.map_department(F.col("department"), F.col("admission_type")),
            "admission_bucket": S.floor_hour(F.col("admission_time")),
        })
        .withColumns({
            "discharge_bucket": F.when(last <= first, S.plus_hours(first, F.lit(1))).otherwise(last),
            "is_emergency": S.is_emergency_case(F.col("mapped_department"), F.col("admission_type"), urgency),
        })
        .drop("default_stay_micros")
    )
