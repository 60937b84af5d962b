"""Times written as text: which layout a column uses is voted on by its rows, for each file.

A layout is a form of date, with a 24-hour or 12-hour clock behind it or none. Most are plain from the text alone. Dates
such as 01/02/2026 are not: there all rows of a file's column decide together, as 13/02/2026 can only be day first.
Each step of a reading is bound once and used by the next, so that every regular expression runs once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bedtide.session import materialise

# The layouts in the order in which they win ties, and the forms of date they are read by.
LAYOUTS = ("iso", "year_first", "month_first", "day_first", "month_name", "compact")
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
WEEKDAY = r"^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,? +"
MONTH = r"(?<![a-z])(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
CLOCK = r"(?:(?:t|,? +)(\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?))?$"
SHAPES = {  # shape: pattern, year-month-day and clock by its groups
    "iso": (r"^(\d{4}-\d.*)$", "$1"),
    "year_first": (r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})" + CLOCK, "$1-$3-$4 $5"),
    "numeric": (r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4})" + CLOCK, "$4-$1-$3 $5"),
    "month_day": (r"^@(\d{1,2})[- ]+(\d{1,2})(?:st|nd|rd|th)?,? +(\d{4})" + CLOCK, "$3-$1-$2 $4"),
    "day_month": (r"^(\d{1,2})(?:st|nd|rd|th)?[- ]+@(\d{1,2})[-, ]+(\d{4})" + CLOCK, "$3-$2-$1 $4"),
    "compact": (r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"),
    "compact_minute": (r"^(\d{4})(\d{2})(\d{2})[t ]?(\d{2})(\d{2})$", "$1-$2-$3 $4:$5"),
    "compact_second": (r"^(\d{4})(\d{2})(\d{2})[t ]?(\d{2})(\d{2})(\d{2})$", "$1-$2-$3 $4:$5:$6"),
}
DAY_FIRST = "$4-$3-$1 $5"
FIGURES = r"^\d[-\d/.:+]*(?: [-\d/.:+]+)?\z"  # no letter, and no blanks but one between date and clock
SPACE = r"[\s\u00a0\u202f]"
SHORT_YEAR = r"^(\d{1,2}([-/.])\d{1,2}\2)"
LAYOUT_OF_SHAPE = {
    "iso": "iso", "year_first": "year_first", "month_day": "month_name", "day_month": "month_name",
    "compact": "compact", "compact_minute": "compact", "compact_second": "compact",
}


def _shift(read: Column, clock: Column, half: Column) -> Column:
    """A time read off a 24-hour clock, moved to the half of the day it names; NULL where a 12-hour clock can't show it."""
    hour = F.regexp_extract(clock, r" 0?(\d{1,2}):", 1).try_cast("int")
    moved = F.when((half == "p") & (hour < 12), 12).when((half == "a") & (hour == 12), -12).otherwise(0)
    return F.when(half == "", read).when(hour.between(1, 12), F.timestamp_micros(F.unix_micros(read) + moved * F.lit(3_600_000_000)))


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, computed once: as a variable of a function it is not copied to where it is used, however often that is."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _reading(column: Column) -> Column:
    """(shape, time, swapped) of a text."""
    def with_century(bare: Column) -> Column:
        written = F.regexp_replace(F.regexp_replace(bare, SHORT_YEAR + r"(69|[7-9]\d)(?!\d)", "$119$3"), SHORT_YEAR + r"(\d\d)(?!\d)", "$120$3")
        return F.when(bare.rlike(SHORT_YEAR + r"\d\d(?!\d)"), written).otherwise(bare)

    def by_text(text: Column) -> Column:
        name = F.regexp_extract(text, MONTH, 1)
        number = F.concat(F.lit("@"), (F.floor(F.call_function("instr", F.lit(MONTHS), name) / 3) + 1).cast("string"))
        bare = F.regexp_replace(text, r"(?<=\d) *[ap]\.?m\.?$", "")
        half = F.regexp_extract(text, r"\d *([ap])\.?m\.?$", 1)
        words = F.struct(half.alias("half"), F.when(name != "", F.regexp_replace(bare, F.lit(MONTH), number)).otherwise(with_century(bare)).alias("bare"))
        return _let(F.when(text.rlike(FIGURES), F.struct(F.lit("").alias("half"), with_century(text).alias("bare"))).otherwise(words), by_parts)

    def by_parts(parts: Column) -> Column:
        fits = {shape: parts["bare"].rlike(pattern) & ((parts["half"] == "") if shape == "iso" else F.lit(True)) for shape, (pattern, _) in SHAPES.items()}
        return _let(F.coalesce(*[F.when(hit, shape) for shape, hit in fits.items()]), lambda shape: by_shape(parts, shape))

    def by_shape(parts: Column, shape: Column) -> Column:
        plain = F.lit(None).cast("string")
        for name, (pattern, order) in SHAPES.items():
            plain = F.when(shape == name, F.regexp_replace(parts["bare"], pattern, order)).otherwise(plain)
        turned = F.when(shape == "numeric", F.regexp_replace(parts["bare"], SHAPES["numeric"][0], DAY_FIRST))
        written = F.struct(F.trim(plain).alias("plain"), F.trim(turned).alias("turned"))
        stamp = lambda text: _shift(F.try_to_timestamp(F.upper(text)), text, parts["half"])
        return _let(written, lambda w: F.struct(shape.alias("shape"), stamp(w["plain"]).alias("time"), stamp(w["turned"]).alias("swapped")))

    def cleaned(text: Column) -> Column:
        spaced = F.when(text.rlike(r"(?! )" + SPACE + "|  "), F.regexp_replace(text, SPACE + "+", " ")).otherwise(text)
        return F.when(text.rlike(FIGURES), text).otherwise(F.regexp_replace(F.lower(F.trim(spaced)), WEEKDAY, ""))

    return _let(_let(column.cast("string"), cleaned), by_text)


def read_times(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with, for each text column c, ``c_read``: its shape, time (numeric dates month first) and swapped (numeric dates day
    first, NULL for others). Times without a zone are UTC; what is no time is NULL. Years of two digits are 1969 to 2068."""
    return df.withColumns({f"{c}_read": _reading(F.col(f"`{c}`")) for c in columns})


def _readings(c: str) -> dict[str, Column]:
    """By layout, what it reads in column ``c`` of ``read_times``."""
    read = F.col(f"`{c}_read`")
    found = {"month_first": F.when(read["shape"] == "numeric", read["time"]), "day_first": read["swapped"]}
    for layout in LAYOUTS:
        shapes = [s for s, name in LAYOUT_OF_SHAPE.items() if name == layout]
        if shapes:
            found[layout] = F.when(read["shape"].isin(shapes), read["time"])
    return {layout: found[layout] for layout in LAYOUTS}


def votes(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """One row per file (``by``): how many rows each layout reads in each column (``<column>_<layout>``), the layout that reads
    most (``<column>_layout``, the first of equals, NULL where none reads any), and whether more rows can be read day first
    than month first (``<column>_is_day_first``). A map-side aggregate over the time columns alone."""
    return _counted(read_times(df.select(*by, *columns), columns), columns, by)


def _counted(read: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """``votes`` of what ``read_times`` has read."""
    counts = [F.count(reading).alias(f"{c}_{name}") for c in columns for name, reading in _readings(c).items()]
    counted = read.groupBy(*by).agg(*counts)
    chosen = {}
    for c in columns:
        most = F.greatest(*[F.col(f"{c}_{name}") for name in LAYOUTS])
        chosen[f"{c}_layout"] = F.coalesce(*[F.when((F.col(f"{c}_{name}") == most) & (most > 0), name) for name in LAYOUTS])
        chosen[f"{c}_is_day_first"] = F.col(f"{c}_day_first") > F.col(f"{c}_month_first")
    return counted.withColumns(chosen)


def vote_table(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """(by, column, layout, parsed, chosen) of every layout that reads a row of its column."""
    entries = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(name).alias("layout"), F.col(f"{c}_{name}").alias("parsed"), (F.col(f"{c}_layout") == name).alias("chosen"))
        for c in columns for name in LAYOUTS
    ])
    return votes(df, columns, by).select(*by, F.inline(entries)).where("parsed > 0")


def with_times(df: DataFrame, columns: list[str], by: list[str] | None = None, strict: bool = False) -> DataFrame:
    """``df`` with its text ``columns`` as timestamps and, for each, ``<column>_fault``: NULL, or why it could not be read.

    With ``by`` (columns that tell files apart) the order of day and month is the one that reads more rows of that column in
    that file; month first where both read equally many, and without ``by``. Texts of other layouts that leave no doubt are
    read as well, unless ``strict`` allows the elected layout alone. Faults are ``missing``, ``other layout``
    (a time, but not in this file's layout) and ``unreadable``. Texts are read once: with ``by`` the readings are written, and
    so are the votes, which have a row for each file.
    """
    rows = read_times(df, columns)
    if by is not None:
        rows = materialise(rows)
        found = materialise(_counted(rows, columns, by).select(
            *(F.col(f"`{b}`").alias(f"_by_{i}") for i, b in enumerate(by)), *(f"{c}_{x}" for c in columns for x in ("layout", "is_day_first"))))
        same = reduce(lambda a, b: a & b, (F.col(f"`{b}`").eqNullSafe(F.col(f"_by_{i}")) for i, b in enumerate(by)), F.lit(True))
        rows = rows.join(found, same, "left")
    added = {}
    for c in columns:
        readings, read = _readings(c), F.col(f"`{c}_read`")
        if by is None:
            time = read["time"]
        elif strict:
            time = F.coalesce(*[F.when(F.col(f"{c}_layout") == name, r) for name, r in readings.items()])
        else:
            time = F.when((read["shape"] == "numeric") & F.col(f"{c}_is_day_first"), read["swapped"]).otherwise(read["time"])
        some = F.coalesce(read["time"], read["swapped"]).isNotNull()
        blank = F.coalesce(F.trim(F.col(f"`{c}`").cast("string")) == "", F.lit(True))
        added[c] = time
        added[f"{c}_fault"] = F.when(blank, "missing").when(time.isNull() & some, "other layout").when(time.isNull(), "unreadable")
    kept = [added[c].alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns]
    return rows.select(*kept, *(added[f"{c}_fault"].alias(f"{c}_fault") for c in columns))
