"""Fixity audit of WARC replicas with Merkle trees.

Records are hashed, then ordered offset ranges: a range of 64 KB hashes the offsets and hashes of its records,
one of 1 MB those of its ranges, and so on up to the archive's root. Two replicas are compared by their roots;
only below a root that differs are ranges compared, and only below ranges that differ, records.

Every node is made of at most sixteen ranges, or the records of 64 KB, so no group grows with the archive.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bedtide.llm.frames import pick
from bedtide.session import materialise

RANGE, FANOUT, LEVELS = 64 << 10, 16, 3  # 64 KB, 1 MB, 16 MB; above them the root over at most a few dozen ranges
ARCHIVE_BYTES = 256 << 20


def warc_record(page_id: Column, url: Column, payload: Column) -> Column:
    """One WARC resource record as bytes. Nulls count as empty."""
    body = F.coalesce(payload, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n")).cast("binary")


def archives(records: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Columns page_id and record as archives: (archive, offset, length, page_id, record), written.

    Every task writes archives of its own, one after another, as a crawler does, so equal or frequent ids need no
    shuffle and no archive outgrows ``archive_bytes`` by more than a record.
    """
    rows = records.select("page_id", "record")

    def run(batches):
        number, offset = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            names, offsets, lengths = [], [], []
            for length in pa.compute.binary_length(batch.column(1)).to_pylist():
                if offset >= archive_bytes:
                    number, offset = number + 1, 0
                names.append(number)
                offsets.append(offset)
                lengths.append(length)
                offset += length
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()), *batch.columns],
                names=["archive", "offset", "length", "page_id", "record"])

    return materialise(rows.mapInArrow(run, f"archive bigint, offset bigint, length bigint, page_id {rows.schema['page_id'].dataType.simpleString()}, record binary"))


@dataclass
class MerkleTree:
    """``records`` are the leaves (archive, offset, length, page_id, hash); ``levels`` the ranges from small to
    large as (archive, node, hash); ``roots`` has one hash for each archive."""

    records: DataFrame
    levels: list[DataFrame]
    roots: DataFrame


def _parents(children: DataFrame, node: Column) -> DataFrame:
    line = F.concat_ws(":", F.col("place").cast("string"), "hash")
    return children.groupBy("archive", node.alias("node")).agg(
        F.sha2(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("place", line.alias("line")))), lambda s: s["line"])), 256).alias("hash")
    )


def merkle_tree(records: DataFrame) -> MerkleTree:
    """The tree over (archive, offset, length, page_id, record). Records at one offset are hashed side by side."""
    leaves = materialise(records.select("archive", "offset", "length", "page_id", F.sha2("record", 256).alias("hash")))
    levels, below, size = [], leaves.withColumn("place", F.col("offset")), RANGE
    for _ in range(LEVELS):
        levels.append(materialise(_parents(below, F.floor(F.col("place") / size).cast("bigint"))))
        below, size = levels[-1].withColumnRenamed("node", "place"), FANOUT
    return MerkleTree(leaves, levels, materialise(_parents(below, F.lit(0).cast("bigint")).drop("node")))


def _differing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose hashes differ or that only one side has."""
    a, b = left.select(*keys, F.col("hash").alias("hash_a")), right.select(*keys, F.col("hash").alias("hash_b"))
    return a.join(b, keys, "full").where(~F.col("hash_a").eqNullSafe(F.col("hash_b")))


def audit(first: MerkleTree, second: MerkleTree) -> DataFrame:
    """Records that differ: (archive, offset, length, page_id, status, hash_a, hash_b), status ``changed``,
    ``missing`` (from the second) or ``added`` (to the second).

    Empty replicas differ in every record of the other. Repeated records at an offset are compared as a set.
    """
    bad = materialise(_differing(first.roots, second.roots, ["archive"]).select("archive"))
    keys, step = ["archive"], None
    for level in reversed(range(LEVELS)):
        inside = [t.levels[level] for t in (first, second)]
        if step is not None:
            inside = [t.withColumn("up", F.floor(F.col("node") / FANOUT).cast("bigint")) for t in inside]
            bad = bad.withColumnRenamed("node", "up")
            keys = ["archive", "up"]
        inside = [t.join(bad, keys, "left_semi") for t in inside]
        bad = materialise(_differing(inside[0], inside[1], ["archive", "node"]).select("archive", "node"))
        step = level
    sides = [t.records.withColumn("node", F.floor(F.col("offset") / RANGE).cast("bigint")).join(bad, ["archive", "node"], "left_semi") for t in (first, second)]
    names = ("length", "page_id", "hash")
    a, b = (t.select("archive", "offset", *(F.col(n).alias(f"{n}_{x}") for n in names)) for t, x in zip(sides, "ab"))
    status = F.when(F.col("hash_b").isNull(), "missing").when(F.col("hash_a").isNull(), "added").otherwise("changed")
    return a.join(b, ["archive", "offset"], "full").where(~F.col("hash_a").eqNullSafe(F.col("hash_b"))).select(
        "archive", "offset", F.coalesce("length_a", "length_b").alias("length"), F.coalesce("page_id_a", "page_id_b").alias("page_id"),
        status.alias("status"), "hash_a", "hash_b",
    )


def audited_pages(pages: DataFrame) -> DataFrame:
    """Audit of two replicas of all pages, the second with known damage: by the checksum of the page id, one page in
    256 has the first character of its payload overwritten, another one is lost."""
    rows = pick(pages, page_id="page_id", url="url", html="html")
    name = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    lot = F.substring(F.md5(name), 1, 2)
    first = archives(rows.select("page_id", warc_record(F.col("page_id"), F.col("url"), F.col("html")).alias("record")))
    text = F.col("record").cast("string")
    at = F.instr(text, "\r\n\r\n") + 4
    spoiled = F.concat(F.substring(text, F.lit(1), at - 1), F.lit("?"), F.substring(text, at + 1, F.length(text))).cast("binary")
    damaged = F.when(lot == "00", spoiled).otherwise(F.col("record"))
    second = first.where(lot != "01").withColumn("record", damaged)
    return audit(merkle_tree(first), merkle_tree(second))
