"""Benchmark decontamination by winnowing.

A text's fingerprints are, for every window of w consecutive k-grams of words, the smallest k-gram hash (the
rightmost of equals). With w + k - 1 = m, two texts that share m consecutive words share a whole window and
so a fingerprint inside it, at the same place: nothing of m words or more is missed. Shared fingerprints are
then extended word by word to the left and right, on the words themselves, and count if the run reaches m.

m is 13 words; an item of n < 13 words is one window, found with m = n. Each of the at most 13 lengths that the
benchmark holds has fingerprints of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bedtide.llm import text as X
from bedtide.llm.frames import documents_of, left_join, pick
from bedtide.session import materialise

WINDOW, GRAM = 13, 5
SHARE = 20  # contaminated from a twentieth of the words
FILTER_BITS = 16, 1 << 28  # bits for each fingerprint; most bits, 32 MB

SEED = "m int, fp bigint, pos bigint, n_left int, context binary"


def parameters(m: int) -> tuple[int, int]:
    """k and w that guarantee shared spans of ``m`` words."""
    k = min(GRAM, m)
    return k, m - k + 1


def winnow(grams: np.ndarray, valid: np.ndarray, w: int) -> np.ndarray:
    """Positions of the fingerprints: for each window start that is ``valid``, its rightmost smallest gram."""
    n = len(grams) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = grams[:n].copy(), np.zeros(n, np.int16)
    for i in range(1, w):
        lower = grams[i:i + n] <= best
        best[lower] = grams[i:i + n][lower]
        at[lower] = i
    starts = np.flatnonzero(valid[:n])
    chosen = np.zeros(len(grams), bool)
    chosen[starts + at[starts]] = True
    return np.flatnonzero(chosen)


def slots(fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bit positions of a fingerprint in a filter of ``bits`` (a power of two)."""
    mask = np.uint64(bits - 1)
    return (fp & mask).astype(np.int64), ((fp >> np.uint64(32)) * np.uint64(0x9E3779B1) & mask).astype(np.int64)


def _seeds(body, starts, ends, words, firsts, lengths, passes=None):
    """Yields (text index, m, fp, pos, n_left, context) of the fingerprints of a chunk of texts.

    ``lengths[m]`` tells which texts are fingerprinted with m; ``passes`` filters fingerprints.
    """
    text_of = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    for m, chosen in lengths.items():
        k, w = parameters(m)
        grams = X.gram_hashes(words, k)
        if not len(grams):
            continue
        grams ^= np.uint64(m)
        starts_ok = np.zeros(len(grams), bool)
        room = firsts[1:][text_of] - np.arange(len(words)) >= m
        starts_ok[:] = (room & chosen[text_of])[:len(grams)]
        at = winnow(grams, starts_ok, w)
        if passes is not None and len(at):
            at = at[passes(grams[at])]
        for p in at.tolist():
            t = int(text_of[p])
            low, high = max(int(firsts[t]), p - (m - k)), min(int(firsts[t + 1]), p + m)
            context = b" ".join([body[a:b] for a, b in zip(starts[low:high].tolist(), ends[low:high].tolist())])
            yield t, m, grams[p], p - int(firsts[t]), p - low, context


def _chunk_words(body, offsets):
    body = X.LOWER[body]
    starts, ends, firsts = X.word_bounds(body, offsets, X.PLAIN)
    return body.tobytes(), starts, ends, firsts, X.span_hashes(body, starts, ends)


def item_seeds(items: DataFrame) -> DataFrame:
    """(item, m, fp, n_left, context): distinct fingerprints of the items with the words around them."""
    def run(batches):
        for batch in batches:
            for part, body, offsets in X.chunks(batch):
                raw, starts, ends, firsts, words = _chunk_words(body, offsets)
                size = np.diff(firsts)
                lengths = {int(m): np.minimum(size, WINDOW) == m for m in np.unique(np.minimum(size, WINDOW)) if m}
                found = list(_seeds(raw, starts, ends, words, firsts, lengths))
                names = part.column(0).to_pylist()
                yield pa.RecordBatch.from_pydict({
                    "item": pa.array([names[s[0]] for s in found], pa.string()),
                    "m": pa.array([s[1] for s in found], pa.int32()),
                    "fp": pa.array(np.array([s[2] for s in found], np.uint64).view(np.int64)),
                    "n_left": pa.array([s[4] for s in found], pa.int32()),
                    "context": pa.array([s[5] for s in found], pa.binary()),
                })

    rows = pick(items, item="item_id", text="text").select(F.coalesce(F.col("item").cast("string"), F.lit("")).alias("item"), "text")
    return rows.mapInArrow(run, "item string, m int, fp bigint, n_left int, context binary").distinct()


def fingerprint_filter(seeds: DataFrame, n: int) -> np.ndarray:
    """Bits that are set for every fingerprint of ``seeds``. The size follows ``n`` up to 32 MB; where that is
    too little the filter passes more rows on to the join, and loses none."""
    per, most = FILTER_BITS
    bits = 1 << max(10, min(most.bit_length() - 1, (n * per).bit_length()))

    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(slots(fp, bits))))], names=["slot"])

    words = seeds.select("fp").mapInArrow(run, "slot bigint").groupBy((F.col("slot") / 64).cast("bigint").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits")
    ).toArrow()  # at most bits / 64 rows
    filled = np.zeros(bits // 64, np.int64)
    filled[words["word"].to_numpy()] = words["bits"].to_numpy()
    return filled.view(np.uint8)


def document_seeds(documents: DataFrame, lengths: list[int], bloom) -> DataFrame:
    """One row for each document with its word count and those fingerprints that pass the filter ``bloom``."""
    rows = documents_of(documents).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    seed = pa.list_(pa.struct([("m", pa.int32()), ("fp", pa.int64()), ("pos", pa.int64()), ("n_left", pa.int32()), ("context", pa.binary())]))

    def run(batches):
        table = bloom.value
        bits = len(table) * 8

        def passes(fp):
            a, b = slots(fp, bits)
            return (table[a >> 3] >> (a & 7).astype(np.uint8) & table[b >> 3] >> (b & 7).astype(np.uint8) & 1).astype(bool)

        for batch in batches:
            for part, body, offsets in X.chunks(batch):
                raw, starts, ends, firsts, words = _chunk_words(body, offsets)
                everything = np.ones(part.num_rows, bool)
                seeds = [[] for _ in range(part.num_rows)]
                for t, m, fp, pos, n_left, context in _seeds(raw, starts, ends, words, firsts, dict.fromkeys(lengths, everything), passes):
                    seeds[t].append({"m": m, "fp": int(fp.view(np.int64)), "pos": pos, "n_left": n_left, "context": context})
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(np.diff(firsts).astype(np.int64)), pa.array(seeds, seed)],
                    names=["doc_id", "text_key", "n_words", "seeds"],
                )

    return rows.mapInArrow(run, f"doc_id {kind}, text_key bigint, n_words bigint, seeds array<struct<{SEED.replace(' ', ':').replace(',:', ',')}>>")


def extend(m: int, pos: int, left: list[bytes], at: int, other: list[bytes], other_at: int) -> tuple[int, int] | None:
    """The run of equal words around a shared gram as document word positions, if it has ``m`` words."""
    k = parameters(m)[0]
    if left[at:at + k] != other[other_at:other_at + k]:
        return None
    low = 0
    while low < min(at, other_at) and left[at - low - 1] == other[other_at - low - 1]:
        low += 1
    high = k
    while at + high < len(left) and other_at + high < len(other) and left[at + high] == other[other_at + high]:
        high += 1
    return (pos - low, pos + high) if low + high >= m else None


def matched_runs(documents: DataFrame, seeds: DataFrame) -> DataFrame:
    """(doc_id, text_key, low, high, item): runs of document words that stand in windows of an item."""
    there = documents.where(F.size("seeds") > 0).select("doc_id", "text_key", F.explode("seeds").alias("s")).select("doc_id", "text_key", "s.*")
    pairs = there.join(seeds.withColumnsRenamed({"n_left": "item_left", "context": "item_context"}), ["m", "fp"])
    pairs = pairs.select("doc_id", "text_key", "item", "m", "pos", "n_left", "context", "item_left", "item_context")
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            keep, low, high = [], [], []
            columns = [batch.column(i).to_pylist() for i in range(3, 9)]
            for i, (m, pos, n_left, context, item_left, item_context) in enumerate(zip(*columns)):
                if span := extend(m, pos, context.split(b" "), n_left, item_context.split(b" "), item_left):
                    keep.append(i)
                    low.append(span[0])
                    high.append(span[1])
            kept = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(kept), batch.column(1).take(kept), batch.column(2).take(kept), pa.array(low, pa.int64()), pa.array(high, pa.int64())],
                names=["doc_id", "text_key", "item", "low", "high"],
            )

    return pairs.mapInArrow(run, f"doc_id {kind}, text_key bigint, item string, low bigint, high bigint").distinct()


def contamination(documents: DataFrame, benchmark: DataFrame, with_key: bool = False) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of ``documents``.

    Null and empty texts have no words and are clean; items without words match nothing; items without an id
    count as one item with an empty name. Repeated rows each get their result, and with an empty benchmark all
    documents are clean. ``with_key`` adds ``text_key``, the xxhash64 of the text.
    """
    seeds = materialise(item_seeds(benchmark))
    lengths = [r["m"] for r in seeds.select("m").distinct().collect()]  # at most 13 values
    bloom = seeds.sparkSession.sparkContext.broadcast(fingerprint_filter(seeds, seeds.count()))
    counted = materialise(document_seeds(documents, lengths, bloom))
    runs = materialise(matched_runs(counted, seeds))
    before = Window.partitionBy("doc_id", "text_key").orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1)
    spans = runs.select("doc_id", "text_key", "low", "high").distinct()
    fresh = F.col("high") - F.greatest("low", F.coalesce(F.max("high").over(before), F.col("low")))
    hit = spans.select("doc_id", "text_key", F.greatest(F.lit(0), fresh).alias("fresh")).groupBy("doc_id", "text_key").agg(F.sum("fresh").alias("n_hit"))
    items = runs.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    found = left_join(hit, items, "doc_id", "text_key")
    n_hit, none = F.coalesce("n_hit", F.lit(0)).cast("bigint"), F.array().cast("array<string>")
    return left_join(counted.drop("seeds"), found, "doc_id", "text_key").withColumn("items", F.coalesce("items", none)).select(
        "doc_id", *["text_key"] * with_key, "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        ((n_hit > 0) & (SHARE * n_hit >= F.col("n_words"))).alias("contaminated"),
    )
