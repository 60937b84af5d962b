"""Columns by position and joins that keep null keys: what every operator needs to take any table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """The columns ``columns.values()`` of ``df`` under the names ``columns.keys()``, and no others.

    Columns are found by exact name and taken by position, so further columns may clash with any name, in
    any case. A column that the table lacks comes as null text.
    """
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    at = {name: f"c{i}" for i, name in reversed(list(enumerate(df.columns)))}
    return plain.select(*(F.col(at[name]).alias(new) if name in at else F.lit(None).cast("string").alias(new)
                          for new, name in columns.items()))


def documents_of(df: DataFrame) -> DataFrame:
    return pick(df, doc_id="doc_id", text="text")


def same(left: DataFrame, right: DataFrame, *keys: str) -> Column:
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[k]) for k in keys))


def left_join(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Left join on keys that may be null; the right side's keys go."""
    other = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, (left[k].eqNullSafe(other[f"_{k}"]) for k in keys))
    return left.join(other, on, "left").drop(*(f"_{k}" for k in keys))
