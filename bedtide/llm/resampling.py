"""Importance resampling towards a target text set, on hashed word windows.

An untrained pre-tokeniser of the ``tokenizers`` library, a Split by a regular expression over the text with A-Z in
lower case, gives words with their offsets. A window of words is the pair of its first and last offset; its words,
joined by a space, go by crc32 to a bucket. The buckets' histograms of both text sets give each bucket a gain, the log
of the ratio of its shares; a document weighs what its windows gain on the mean. Gumbel noise from a hash of the
document's id turns the highest scores into a sample without replacement.

A blank is never part of a word, so the Split runs once on each distinct run of non-blanks of some megabytes of text and
its words are dealt back to all places.
"""

from __future__ import annotations

from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bedtide.llm import spans
from bedtide.llm import text as X
from bedtide.llm.frames import pick
from bedtide.session import materialise

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, WINDOW, MIN_WORDS, SHARE, SEED = 10000, (1, 1), 20, (10, 100), 2024
JOINED_BYTES = 1 << 20


@cache
def splitter():
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(WORD), "removed", True)


def _split(pieces: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Words of all pieces, the piece of each, and its start and end in it in code points."""
    words, piece, starts, ends = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    sizes = np.cumsum([len(p) + 1 for p in pieces])
    first = 0
    while first < len(pieces):
        last = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + JOINED_BYTES, "right")))
        some = [p.decode() for p in pieces[first:last]]
        found = splitter().pre_tokenize_str("\n".join(some))
        places = np.array([at for _, at in found], np.int64).reshape(-1, 2)
        begin = np.cumsum([0, *(len(t) + 1 for t in some)])
        owner = np.searchsorted(begin, places[:, 0], "right") - 1
        words += [w for w, _ in found]
        piece.append(owner + first)
        starts.append(places[:, 0] - begin[owner])
        ends.append(places[:, 1] - begin[owner])
        first = last
    return words, *(np.concatenate(x) for x in (piece, starts, ends))


def offset_words(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Of each word: its text, start and end in that text (code points), index of its string; and the strings."""
    body = X.LOWER[body]
    starts, ends, firsts = X.word_bounds(body, offsets, X.UNSPACED)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
    points = np.concatenate([[0], np.cumsum((body & 0xC0) != 0x80, dtype=np.int64)])
    found, strings = [], []
    for a, b in spans.slices(starts, ends):
        some, low, high = body[starts[a]:ends[b - 1]], starts[a:b] - starts[a], ends[a:b] - starts[a]
        first, which = spans.distinct(some, low, high)
        words, piece, at, to = _split(spans.strings(some, low[first], high[first]))
        number = np.bincount(piece, minlength=len(first))
        begin = np.cumsum(number) - number
        some = spans.flat(begin[which], number[which])
        place = np.repeat(np.arange(a, b), number[which])
        base = points[starts[place]] - points[offsets[owner[place]]]
        found.append((owner[place], base + at[some], base + to[some], some + len(strings)))
        strings += [w.encode() for w in words]
    none = np.zeros(0, np.int64)
    return *(np.concatenate([none, *(f[i] for f in found)]) for i in range(4)), strings


def windows(body: np.ndarray, offsets: np.ndarray, window: tuple[int, int] = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each window: its text, its offset pair, and the crc32 of its words joined by one space."""
    owner, starts, ends, string, strings = offset_words(body, offsets)
    found = []
    for k in range(window[0], window[1] + 1):
        n = max(0, len(owner) - k + 1)
        inside = np.flatnonzero(owner[:n] == owner[k - 1:][:n])
        if k == 1:
            crc = np.array([crc32(s) for s in strings], np.int64)[string] if strings else np.zeros(0, np.int64)
        else:
            crc = np.array([crc32(b" ".join([strings[w] for w in string[i:i + k]])) for i in inside], np.int64)
        found.append((owner[inside], starts[inside], ends[inside + k - 1], crc[inside] if k == 1 else crc))
    return tuple(np.concatenate([f[i] for f in found]) for i in range(4))


def bucket_counts(texts: DataFrame, id_column: str, window: tuple[int, int] = WINDOW, buckets: int = BUCKETS) -> DataFrame:
    """(id, n_words, n_features, buckets, counts) of each row: its windows by bucket."""
    rows = pick(texts, id=id_column, text="text")

    def lists(values, firsts):
        return pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), pa.array(values, pa.int32()))

    def run(batches):
        for batch in batches:
            for part, body, offsets in X.chunks(batch):
                n = part.num_rows
                owner, _, _, crc = windows(body, offsets, window)
                words = np.bincount(owner, minlength=n) if window == (1, 1) else np.bincount(offset_words(body, offsets)[0], minlength=n)
                codes, counts = np.unique(owner * buckets + crc % buckets, return_counts=True)
                firsts = np.searchsorted(codes, np.arange(n + 1) * buckets)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(words, pa.int64()), pa.array(np.bincount(owner, minlength=n), pa.int64()), lists(codes % buckets, firsts), lists(counts, firsts),
                ], names=["id", "n_words", "n_features", "buckets", "counts"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_words bigint, n_features bigint, buckets array<int>, counts array<int>")


def histogram(counted: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Windows in each bucket over all rows; at most ``buckets`` numbers reach the driver."""
    def run(batches):
        for batch in batches:
            at, n = (batch.column(i).flatten().to_numpy() for i in (0, 1))
            sums = np.bincount(at, n, buckets).astype(np.int64)
            some = np.flatnonzero(sums)
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int32()), "n": pa.array(sums[some])})

    sums = counted.select("buckets", "counts").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    found = np.zeros(buckets, np.int64)
    found[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return found


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed share in the target over that in the source) of each bucket."""
    s, t, b = source.astype(float), target.astype(float), len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + b) / ((s + 1) * (t.sum() + b)))).astype(np.int64)


def weights(counted: DataFrame, gain: np.ndarray) -> DataFrame:
    """``counted`` with ``weight``, the floored mean gain of a row's windows, in place of the buckets."""
    shared = counted.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def run(batches):
        for batch in batches:
            at, n = (batch.column(i).flatten().to_numpy() for i in (3, 4))
            total = np.concatenate([[0], np.cumsum(shared.value[at] * n)])
            firsts = np.concatenate([[0], np.cumsum(batch.column(3).value_lengths().to_numpy())])
            features = batch.column(2).to_numpy()
            mean = (total[firsts[1:]] - total[firsts[:-1]]) // np.maximum(features, 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(mean, pa.int64())], names=["id", "n_words", "n_features", "weight"])

    kind = counted.schema["id"].dataType.simpleString()
    return counted.select("id", "n_words", "n_features", "buckets", "counts").mapInArrow(run, f"id {kind}, n_words bigint, n_features bigint, weight bigint")


def noise(key, seed: int = SEED):
    """Gumbel noise in thousandths from the hash of "seed:key"."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def drawn_ranks(scored: DataFrame, share: tuple[int, int] = SHARE, min_words: int = MIN_WORDS) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3... by falling score, then id, for the share drawn of the rows with enough words.

    Scores are whole numbers within a few ten thousand of zero, so the table of rows per score stays small however
    many rows there are; it tells the first rank of each score, and only rows of one score are ordered among themselves.
    """
    enough = F.col("n_words") >= min_words
    levels = scored.where(enough).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    falling = Window.orderBy(F.desc("score"))
    before = F.coalesce(F.sum("n").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    drawn = F.floor(F.sum("n").over(Window.partitionBy()) * share[0] / share[1])
    levels = materialise(levels.select("score", before.alias("before"), drawn.alias("drawn"))).where("before < drawn")
    placed = scored.withColumn("level", F.when(enough, F.col("score"))).join(levels.withColumnRenamed("score", "level"), "level", "left")
    own = F.row_number().over(Window.partitionBy("level").orderBy("id"))
    ranked = placed.where("before is not null").withColumn("rank", F.col("before") + own)
    kept = F.when(F.col("rank") <= F.col("drawn"), F.col("rank")).cast("bigint").alias("rank")
    columns = [F.col(c) for c in scored.columns]
    return ranked.select(*columns, kept).unionByName(placed.where("before is null").select(*columns, F.lit(None).cast("bigint").alias("rank")))


def resample(documents: DataFrame, target: DataFrame, window: tuple[int, int] = WINDOW, buckets: int = BUCKETS, share: tuple[int, int] = SHARE,
             min_words: int = MIN_WORDS, seed: int = SEED, target_id: str = "item_id") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of each row of ``documents`` (doc_id, text).

    ``target`` has the texts to resemble. Of the rows with at least ``min_words`` words the ``share`` with the highest scores
    is drawn and ranked, ties by doc_id; the others have no rank. Null and empty texts have no windows and weight 0; a null
    doc_id hashes as empty text and ranks first among equals; repeated rows are rows of their own, with adjoining ranks. Where either
    table is empty the gains come from the other one alone; no documents give no rows.
    """
    counted = materialise(bucket_counts(documents, "doc_id", window, buckets))
    wanted = histogram(bucket_counts(target, target_id, window, buckets), buckets)
    weighed = weights(counted, gains(histogram(counted, buckets), wanted))
    scored = materialise(weighed.withColumn("score", F.col("weight") + noise(F.col("id"), seed)))
    return drawn_ranks(scored, share, min_words).withColumnRenamed("id", "doc_id")
