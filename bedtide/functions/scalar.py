"""Column expressions. Everything here runs inside the JVM; there are no Python UDFs."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from bedtide import config as C

MICROS_PER_HOUR = 3_600_000_000


# --- null-safe coercion -----------------------------------------------------------------------
def coerce_ts(col: Column) -> Column:
    """Text to timestamp; anything unreadable becomes NULL."""
    return F.try_to_timestamp(F.trim(col.cast("string")))


def coerce_num(col: Column) -> Column:
    """Text to double; anything unreadable, NULL or NaN becomes 0."""
    number = col.cast("string").try_cast("double")
    return F.coalesce(F.when(~F.isnan(number), number), F.lit(0.0))


# --- hours --------------------------------------------------------------------------------------
def floor_hour(ts: Column) -> Column:
    return F.date_trunc("hour", ts)


def ceil_hour(ts: Column) -> Column:
    return F.date_trunc("hour", F.timestamp_micros(F.unix_micros(ts) + F.lit(MICROS_PER_HOUR - 1)))


def plus_hours(ts: Column, hours: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + hours.cast("bigint") * F.lit(MICROS_PER_HOUR))


def plus_micros(ts: Column, micros: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + micros)


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def calendar(ts: Column) -> dict[str, Column]:
    """The eight calendar features of a timestamp, Monday = 0."""
    hour, dow = F.hour(ts), F.weekday(ts)
    day_angle = hour * F.lit(2 * math.pi) / 24
    week_angle = dow * F.lit(2 * math.pi) / 7
    values = [
        hour, dow, F.month(ts), (dow >= 5).cast("int"),
        F.sin(day_angle), F.cos(day_angle), F.sin(week_angle), F.cos(week_angle),
    ]
    return dict(zip(C.CALENDAR_FEATURES, values))


# --- numbers ----------------------------------------------------------------------------------
def round_binary(col: Column, digits: int) -> Column:
    """Round the exact binary value, ties to even: 2.675 -> 2.67 and 0.125 -> 0.12 at two digits.

    ``round`` and ``bround`` work on the shortest decimal text instead (2.675 -> 2.68), which moves
    utilizations such as 3/80 across a threshold. ``format_number`` rounds the binary value.
    """
    return F.replace(F.format_number(col, digits), F.lit(","), F.lit("")).cast("double")


def clamp(col: Column, low: Column | float, high: Column | float) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.greatest(low, F.least(high, col))


def capacity_of(peak: Column, default: Column | int) -> Column:
    """Peak plus 12 %, never under the default, raised to the next multiple of five."""
    default = default if isinstance(default, Column) else F.lit(default)
    wanted = F.greatest(default.cast("double"), F.coalesce(peak, F.lit(0.0)) * F.lit(C.CAPACITY_BUFFER))
    steps = F.ceil(wanted / F.lit(float(C.CAPACITY_STEP))).cast("int")
    return F.greatest(F.lit(C.CAPACITY_STEP), steps * F.lit(C.CAPACITY_STEP)).cast("int")


def utilization(occupied: Column, capacity: Column) -> Column:
    return F.when(capacity != 0, occupied / capacity).otherwise(F.lit(0.0))


def status_flag(utilization_col: Column) -> Column:
    return utilization_col >= F.lit(C.THRESHOLD_DEFAULT)


def threshold_line(capacity: Column) -> Column:
    """Reference level drawn on forecast charts: 90 % of capacity, halves up."""
    return F.floor(capacity * F.lit(C.THRESHOLD_DEFAULT) + F.lit(0.5)).cast("int")


# --- text -------------------------------------------------------------------------------------
def map_department(department: Column, admission_type: Column) -> Column:
    """Department text and admission type, read together, to one of the four departments."""
    words = F.lower(F.concat_ws(" ", department, admission_type))
    return (
        F.when(words.rlike(C.PEDIATRIC_WORDS), "pediatric")
        .when(words.rlike(f"{C.EMERGENCY_WORDS}|{C.EMERGENCY_SHORT}"), "emergency")
        .when(words.rlike(C.ICU_WORDS), "icu")
        .otherwise("ward")
    )


def is_emergency_case(mapped_department: Column, admission_type: Column, urgency: str = "reference") -> Column:
    """Emergency department, or an urgent admission type.

    ``urgency="reference"`` matches the pattern anywhere ("Scheduled" matches on "ed");
    ``urgency="word"`` asks for ``er`` and ``ed`` as words.
    """
    return (mapped_department == "emergency") | admission_type.rlike("(?i)" + C.URGENCY_PATTERNS[urgency])


def label_of(department: Column) -> Column:
    label = F.lit(None).cast("string")
    for name, text in C.DEPARTMENT_LABELS.items():
        label = F.when(department == name, text).otherwise(label)
    return label


def department_order(department: Column) -> Column:
    position = F.lit(len(C.DEPARTMENTS))
    for index, name in enumerate(C.DEPARTMENTS):
        position = F.when(department == name, index).otherwise(position)
    return position


def percent_text(share: Column) -> Column:
    return F.concat(round_binary(share * F.lit(100.0), 0).cast("int").cast("string"), F.lit("%"))


def severity_of(utilization_col: Column, threshold: Column) -> Column:
    critical = F.least(F.lit(1.0), threshold + F.lit(C.CRITICAL_MARGIN))
    return F.when(utilization_col >= critical, "critical").otherwise("warning")


def alert_message(label: Column, utilization_col: Column, threshold: Column) -> Column:
    return F.concat(
        label, F.lit(" occupancy is forecast to reach "), percent_text(utilization_col),
        F.lit(" against a "), percent_text(threshold), F.lit(" threshold."),
    )
