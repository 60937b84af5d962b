"""SimHash near-duplicates, found with covering locality-sensitive hashing.

Each distinct fingerprint is projected on 2^(r+1) - 1 bit masks. The masks are built from one map of bit
positions to non-zero vectors of r + 1 bits: mask v keeps the positions whose vector has an odd product
with v. Any r differing positions span at most r dimensions, so some non-zero v is orthogonal to all their
vectors, and mask v keeps none of them: every pair within the radius collides in some table, with certainty.

Buckets are never paired off. Two members of a bucket agree on the kept bits and can differ in the free
ones only; for radius 2 they are linked when they share a midpoint, that is when a fingerprint or one of
its one-bit flips in the free bits is the same for both. A midpoint has at most 65 owners, so a bucket of
any size costs rows in proportion to its members, and all owners of a midpoint are within the radius.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bedtide.llm.components import components
from bedtide.llm.frames import documents_of, left_join
from bedtide.session import materialise

SHINGLE, RADIUS, SEED, BITS = 3, 2, 42, 64


def covering_masks(radius: int = RADIUS) -> list[int]:
    """The bits kept by each of the 2^(radius+1) - 1 tables."""
    vectors = [i % (2 ** (radius + 1) - 1) + 1 for i in range(BITS)]
    return [sum(1 << i for i, a in enumerate(vectors) if (a & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def text_fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist())], "<u8")
    ones = np.zeros(BITS, np.int64)
    for part in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[part:part + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, fp) with the 64-bit fingerprint as a signed long, one row for each row of ``documents``."""
    rows = documents_of(documents).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_key bigint, fp bigint"

    def run(batches):
        for batch in batches:
            prints = np.array([text_fingerprint(t.as_py(), shingle) for t in batch.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints.view(np.int64))], names=["doc_id", "text_key", "fp"])

    return rows.mapInArrow(run, schema)


def near_pairs(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between fingerprints ``fp`` whose transitive closure is that of all pairs at two or fewer
    differing bits; every edge is such a pair."""
    masks = covering_masks()
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    tables = distinct.select("fp", F.explode(F.array(*(
        F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("kept")) for t, m in enumerate(masks)
    ))).alias("s")).select("fp", "s.t", "s.kept")
    shared = tables.groupBy("t", "kept").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    members = materialise(tables.join(shared, ["t", "kept"]).select("t", "fp"))
    free = [[signed(1 << i) for i in range(BITS) if not m >> i & 1] for m in masks]
    flips = F.array(*(F.array(*(F.lit(b).cast("bigint") for b in [0, *bits])) for bits in free))
    middles = members.select("fp", F.explode(flips[F.col("t")]).alias("flip")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("middle")).distinct()
    owners = middles.groupBy("middle").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    return owners.select("a", F.explode("all").alias("b")).where("a <> b").distinct()


def _grouped(documents: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of the rows, and (fp, label) with one label for each component."""
    prints = materialise(fingerprints(documents, shingle))
    classes = prints.select("fp").distinct()
    linked = components(near_pairs(classes)).withColumnRenamed("node", "fp")
    return prints, classes.join(linked, "fp", "left").select("fp", F.coalesce("component", "fp").alias("label"))


def simhash_groups(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``documents``.

    Null and empty texts have fingerprint zero and link like any other; repeated rows stay repeated; a row
    without doc_id is grouped by its text and names no component. An empty table gives no rows.
    """
    prints, labels = _grouped(documents, shingle)
    low = prints.groupBy("fp").agg(F.min("doc_id").alias("low")).join(labels, "fp")
    heads = low.groupBy("label").agg(F.min("low").alias("component_id"))
    named = labels.join(heads, "label").select("fp", "component_id")
    return left_join(prints, named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def representatives(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key) of one document of each group: the smallest doc_id, rows without one last."""
    prints, labels = _grouped(documents, shingle)
    first = lambda: F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_key")).alias("head")
    heads = prints.groupBy("fp").agg(first()).join(labels, "fp").groupBy("label").agg(F.min("head").alias("head"))
    return heads.select("head.doc_id", "head.text_key")
