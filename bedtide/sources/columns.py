"""Header handling: works on column names only, so nothing here touches rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bedtide import config as C

ENCOUNTER_TEXT = ["facility_id", "patient_id", "admission_time", "discharge_time", "department", "admission_type"]


def clean_name(name: str) -> str:
    return re.sub("[^a-z0-9]+", "_", name.lower()).strip("_")


def resolve_aliases(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Rename recognised headers to their canonical names; other columns keep theirs.

    Of several headers with the same cleaned name the last one counts, as does the first listed alias.
    """
    by_clean = {clean_name(column): column for column in df.columns}
    chosen = {}
    for canonical, options in aliases.items():
        hit = next((by_clean[option] for option in options if option in by_clean), None)
        if hit is not None:
            chosen[hit] = canonical
    taken = set(chosen.values())
    return df.select(
        *[
            F.col(f"`{column}`").alias(chosen.get(column, column))
            for column in df.columns
            if column in chosen or column not in taken
        ]
    )


def sniff_kind(columns: list[str], kind: str | None = None) -> str:
    """``event`` or ``aggregate``; a header that starts with "admission" and names an encounter field decides.

    Pass ``kind`` to override, e.g. for an encounter file whose only time header is ``admit_time``.
    """
    if kind is not None:
        if kind not in ("event", "aggregate"):
            raise ValueError(f"Unknown dataset kind: {kind}")
        return kind
    known = {alias for options in C.ENCOUNTER_ALIASES.values() for alias in options if alias.startswith("admission")}
    return "event" if known & {clean_name(column) for column in columns} else "aggregate"


def require_columns(df: DataFrame, required: list[str], what: str) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing required columns: {', '.join(missing)}")
    return df


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Add the columns a source does not have; a ``None`` default is a NULL string."""
    absent = {c: (F.lit(v) if v is not None else F.lit(None).cast("string")) for c, v in defaults.items() if c not in df.columns}
    return df.withColumns(absent) if absent else df
