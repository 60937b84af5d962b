"""Quoted CSV files read in byte ranges, by as many tasks as a file has ranges.

A line break ends a record only outside quotes, and whether a range begins inside a quoted field depends on everything before
it. So the lines are read twice. First each range tells, from its lines alone, in which state it ends for either state it may
begin in; composed along a file, that gives the state each range really begins in. Then each range cuts its lines into
records. What a range holds of a record that began in an earlier one, or goes on in the next, is a piece; pieces, at
most two or so a range, are put together by file. The records are written once, as several passes over them follow.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bedtide.session import materialise

_FIELDS = r'(?:"(?:[^"]|"")*+"[^,]*|[^",][^,]*|)'  # one field of a line, closed
OPEN_AT_END = re.compile(rf'(?:{_FIELDS},)*"(?:[^"]|"")*+')
CLOSING = re.compile(r'(?:[^"]|"")*+"(?!")[^,]*')  # from inside a field to the comma behind it


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line that begins inside a quoted field, or outside, ends inside one.

    A quote opens a field only at its beginning; one in the middle of an unquoted field is a character like others.
    """
    if '"' not in line:
        return inside
    if inside:
        closed = CLOSING.match(line)
        if closed is None:
            return True
        rest = line[closed.end():]
        return bool(rest) and ends_inside(rest[1:], False)
    return OPEN_AT_END.fullmatch(line) is not None


def placed_lines(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """(file, start, value, partition columns) of every line, with the first byte of the range it was read in, and the names of
    the partition columns. Lines keep their order within a range."""
    text = spark.read.text(path)
    parts = [c for c in text.columns if c != "value"]
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")]
    return text.select(*place, "value", *(F.col(f"`{c}`").cast("string").alias(c) for c in parts)), parts


def _ranges(batches: Iterator[pa.RecordBatch]):
    """(place, lines) of runs of lines of one range, as they come; a place is the file, the start, and what else is by range."""
    for batch in batches:
        places = [batch.column(i) for i in (0, 1, *range(3, batch.num_columns))]
        first = 0
        for end in sorted({end for c in places for end in pc.run_end_encode(c).run_ends.to_pylist()}):
            yield tuple(c[first].as_py() for c in places), batch.column(2).slice(first, end - first)
            first = end


def range_states(lines: DataFrame) -> DataFrame:
    """(_file, _start, outside, inside): whether a range ends inside quotes if it begins outside of them, or inside."""
    kind = pa.schema([("_file", pa.string()), ("_start", pa.int64()), ("outside", pa.bool_()), ("inside", pa.bool_())])

    def run(batches):
        current, state, found = None, [False, True], []
        for place, values in _ranges(batches):
            if current != place:
                found += [(*current, *state)] if current else []
                current, state = place, [False, True]
            for line in values.filter(pc.match_substring(values, '"')).to_pylist():
                state = [ends_inside(line, s) for s in state]
        found += [(*current, *state)] if current else []
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind.types[i]) for i in range(4)], schema=kind)

    return lines.select("_file", "_start", "value").mapInArrow(run, "_file string, _start bigint, outside boolean, inside boolean")


def begun_inside(states: DataFrame) -> DataFrame:
    """(_file, _start, _inside) of the ranges that begin inside quotes. A file brings a row for each of its ranges."""
    def run(table: pa.Table) -> pa.Table:
        table, state, begins = table.sort_by("_start"), False, []
        for outside, inside in zip(table["outside"].to_pylist(), table["inside"].to_pylist()):
            begins.append(state)
            state = inside if state else outside
        return table.select(["_file", "_start"]).append_column("_inside", pa.array(begins, pa.bool_()))

    return states.groupBy("_file").applyInArrow(run, "_file string, _start bigint, _inside boolean").where("_inside")


def records(lines: DataFrame, begun: DataFrame, parts: list[str]) -> DataFrame:
    """(_file, _start, number, value, head, tail, partition columns): the records of each range in order.

    ``head`` marks what ends a record of an earlier range, ``tail`` what a later range goes on with. ``begun`` has at most one row
    for each range, and only for those that begin inside quotes.
    """
    names = ["_file", "_start", "number", "value", "head", "tail", *parts]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), *[pa.string()] * len(parts)]
    known = lines.join(F.broadcast(begun), ["_file", "_start"], "left").select("_file", "_start", "value", F.coalesce("_inside", F.lit(False)).alias("_inside"), *parts)

    def run(batches):
        current, state, held, number, head = None, False, [], 0, False

        def rows(place, found):
            columns = [[place[0]] * len(found), [place[1]] * len(found), *zip(*found), *([p] * len(found) for p in place[3:])]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)

        def plain(place, values, number):
            """Lines without quotes, met outside of them: each is a record."""
            n = len(values)
            columns = [pa.repeat(pa.scalar(place[0], types[0]), n), pa.repeat(place[1], n), pa.array(np.arange(number, number + n)), values, pa.repeat(False, n), pa.repeat(False, n)]
            return pa.RecordBatch.from_arrays([*columns, *(pa.repeat(pa.scalar(p, pa.string()), n) for p in place[3:])], names=names)

        for place, values in _ranges(batches):
            found = []
            if current != place:
                if held:
                    yield rows(current, [(number, "\n".join(held), head, True)])
                current, state, held, number, head = place, place[2], [], 0, place[2]
            if not state and not pc.any(pc.match_substring(values, '"')).as_py():
                yield plain(place, values, number)
                number += len(values)
                continue
            for line in values.to_pylist():
                held.append(line)
                state = ends_inside(line, state) if '"' in line else state
                if not state:
                    found.append((number, "\n".join(held) if len(held) > 1 else line, head, False))
                    held, number, head = [], number + 1, False
            if found:
                yield rows(place, found)
        if held:
            yield rows(current, [(number, "\n".join(held), head, True)])

    fields = "_file string, _start bigint, number bigint, value string, head boolean, tail boolean" + "".join(f", `{c}` string" for c in parts)
    return known.mapInArrow(run, fields)


def whole_records(found: DataFrame, parts: list[str]) -> DataFrame:
    """(_file, value, is_header, partition columns): records as they are, and those put together from their pieces."""
    first = (F.col("_start") == 0) & (F.col("number") == 0)
    broken = F.col("head") | F.col("tail")
    simple = found.where(~broken).select("_file", "value", first.alias("is_header"), *parts)
    along = Window.partitionBy("_file").orderBy("_start", "number")
    grouped = found.where(broken).withColumn("record", F.sum((~F.col("head")).cast("bigint")).over(along))
    piece = F.sort_array(F.collect_list(F.struct("_start", "number", "value")))
    glued = grouped.groupBy("_file", "record", *parts).agg(piece.alias("p"), F.max(first & ~F.col("head")).alias("is_header"))
    return simple.unionByName(glued.select("_file", F.array_join("p.value", "\n").alias("value"), "is_header", *parts))


def read_quoted_csv(spark: SparkSession, path: str, columns: list[str], corrupt: str, file_column: str) -> DataFrame:
    """The records of CSV files with a header as text ``columns``, the ``corrupt`` record where its number of fields is another one, and
    the file. Records are those that Spark's own reader finds with ``multiLine``; blank lines between them are none.

    All files must have the same header.
    """
    lines, parts = placed_lines(spark, path)
    found = whole_records(materialise(records(lines, begun_inside(range_states(lines)), parts)), parts)
    heads = found.where("is_header").select(F.regexp_replace("value", "^\ufeff", "").alias("value")).distinct().take(2)
    if len(heads) > 1:
        raise ValueError(f"Files have different headers: {heads[0].value[:200]} / {heads[1].value[:200]}")
    data = [c for c in columns if c not in parts]
    kind = T.StructType([T.StructField(c, T.StringType()) for c in [*data, corrupt]])
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt, "multiLine": "true"}
    ddl = ", ".join("`" + f.name.replace("`", "``") + "` string" for f in kind)
    rows = found.where(~F.col("is_header") & (F.trim("value") != "")).withColumn("_row", F.from_csv("value", ddl, options))
    return rows.select(*(F.col("_row").getField(c).alias(c) for c in data), *(F.col(c) for c in parts), F.col("_row").getField(corrupt).alias(corrupt), F.col("_file").alias(file_column))
