"""Removal of byte strings that an earlier document already has, by difference-cover suffix sorting.

A difference cover D of period v has a shift k < v for any two positions i and j such that i + k and j + k
both lie in D modulo v. So two suffixes that agree on L bytes meet again at two suffixes of the cover sample,
k bytes further on, and their order is that of (the k bytes before, rank of the cover sample): ties longer
than k are resolved by ranks, and no task needs the text of another document. The construction is blockwise:

1. *Blocks.* Texts are packed into blocks of a few MB and written, bucketed by block.
2. *Cover sample.* Every block sends the fingerprints of its cover-sample suffixes (v = 21, five in 21, each judged
   by the L - v + 1 bytes that any shift leaves), in sorted, difference-coded ranges. A suffix whose
   fingerprint occurs nowhere else can't tie with any other and goes no further.
3. *Suffix buckets.* The others go into buckets by fingerprint range, half of the buckets in each pass, as
   the v - 1 bytes before and the L bytes after the sample. One bucket at a time is sorted in a task: first the
   sample suffixes, byte by byte, which gives their ranks at every depth from the longest common prefixes of
   neighbours; then for each shift k the suffixes that begin k bytes before, by those k bytes and the rank at
   depth L - k. Equal ones form a run, and all but its smallest document are repeats. Contexts that are equal as a
   whole are equal at each shift, so only one of them is sorted; a shift for which a context shares too few bytes
   with any other, on either side, is left out.
4. *Removal.* Every block gets its repeats back and cuts them out.

Texts stay in a table bucketed by block. What blocks send to ranges and ranges to blocks is shuffled, one range to a
partition, so the number of files grows with the blocks and with the ranges; Spark removes the shuffle files of a step
when it ends. Memory is bounded by the bucket and the block, disk by the pass. Equal contexts of a block are sent once, for
the smallest document that has them, so copies cost one row for each block. A fingerprint that is found in
more than HOT_BLOCKS blocks is dealt out by its full windows, one shift at a time, so that no bucket has to
hold all contexts of a frequent string.
"""

from __future__ import annotations

import contextlib
import hashlib
import math
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bedtide.llm import text as X
from bedtide.llm.frames import pick
from bedtide.session import materialise, shared_folder

LENGTH = 50
PERIOD, COVER = 21, (0, 1, 6, 8, 18)  # a perfect difference set: fixed values
BLOCK_BYTES = 4 << 20
RANGE_SAMPLES = 4 << 20
PASSES = 2
SPARE_BITS = 6
HOT_BLOCKS = 1000
NO_ID = np.iinfo(np.int64).max


_MULTIPLIER = np.uint64(0xBF58476D1CE4E5B9)
_CODECS: list = []


def _codecs() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """One pair for each process: a new one costs more than the few KB that most calls pack."""
    if not _CODECS:
        _CODECS.extend((zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()))
    return _CODECS[0], _CODECS[1]


def _planes(values: np.ndarray) -> bytes:
    """Byte planes of unsigned integers."""
    values = np.ascontiguousarray(values)
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes() if len(values) else b""


def _unplaned(raw: np.ndarray, dtype) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).reshape(-1) if len(raw) else np.zeros(0, dtype)


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted unsigned integers as compressed byte planes of their differences."""
    return _codecs()[0].compress(_planes(np.diff(values, prepend=values.dtype.type(0))))


def unpack_sorted(data: bytes, dtype) -> np.ndarray:
    return np.cumsum(_unplaned(np.frombuffer(_codecs()[1].decompress(data), np.uint8), dtype), dtype=dtype)


def mixed(words) -> np.ndarray:
    """A 64-bit hash of each row of a table of words, given by columns."""
    h = None
    for word in words:
        h = np.full(len(word), X.BASE, np.uint64) if h is None else h
        h ^= word
        h *= _MULTIPLIER
        h ^= h >> np.uint64(32)
    return X.mix(h)


# --- blocks ---------------------------------------------------------------------------------------------
def _blocks(rows: DataFrame, block_bytes: int) -> DataFrame:
    """Rows doc_id, text and others as blocks; the others travel as an Arrow stream."""
    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part, body, offsets in X.chunks(batch, "text", block_bytes):
                ids = pc.fill_null(part.column(0).cast(pa.int64()), NO_ID).to_numpy(zero_copy_only=False)
                rest = pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(part.num_columns) if part.schema.names[i] != "text"],
                    names=[n for n in part.schema.names if n != "text"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rest.schema) as stream:
                    stream.write_batch(rest)
                yield pa.RecordBatch.from_pydict({
                    "block": [number], "n_bytes": [len(body)], "ids": [ids.astype(np.int64).tobytes()], "offsets": [offsets.tobytes()],
                    "body": [body.tobytes()], "rest": [sink.getvalue().to_pybytes()],
                }, schema=pa.schema([("block", pa.int64()), ("n_bytes", pa.int64()), *((n, pa.binary()) for n in ("ids", "offsets", "body", "rest"))]))
                number += 1

    return rows.mapInArrow(run, "block bigint, n_bytes bigint, ids binary, offsets binary, body binary, rest binary")


@contextlib.contextmanager
def _shuffles_cleaned(spark: SparkSession):
    """Spark removes the shuffle files of a write as soon as it ends, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class _Tables:
    """Tables of one run in the warehouse, dropped as soon as they are used up."""

    def __init__(self, spark: SparkSession):
        self.spark, self.made = spark, []

    def put(self, df: DataFrame, key: str | None = None, buckets: int = 0) -> DataFrame:
        """``df`` as a table, bucketed by ``key`` if there is one. Each task writes a file for each bucket it has rows of, so a
        key must have few rows in a task; what many tasks send to many groups is shuffled."""
        name = f"suffixes_{uuid.uuid4().hex}"
        writer = df.write.format("parquet").option("compression", "zstd")
        with _shuffles_cleaned(self.spark):
            (writer.bucketBy(buckets, key) if key else writer).saveAsTable(name)
        self.made.append((self.spark.table(name), name))
        return self.made[-1][0]

    def drop(self, *frames: DataFrame) -> None:
        """The tables behind ``frames``, or all of them."""
        for frame, name in list(self.made):
            if not frames or any(frame is f for f in frames):
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
                self.made.remove((frame, name))


# --- cover sample -----------------------------------------------------------------------------------------
def sample_positions(offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the cover sample with the bytes they are judged by in their document, and the document."""
    cover = np.array(COVER)
    places = np.maximum(np.diff(offsets) - (length - PERIOD), 0)
    n = places // PERIOD * len(cover) + np.searchsorted(cover, places % PERIOD)
    doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
    period, member = np.divmod(np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n), len(cover))
    return offsets[:-1][doc] + period * PERIOD + cover[member], doc


def fingerprints(body: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """64-bit fingerprints of the ``length - PERIOD + 1`` bytes from each position."""
    least = length - PERIOD + 1
    if not len(at):
        return np.zeros(0, np.uint64)
    words = np.ndarray((len(body) - 7,), "<u8", buffer=np.ascontiguousarray(body), strides=(1,))
    return mixed(words[at + o] for o in [*range(0, least - 7, 8), *([least - 8] if least % 8 else [])])


def _sent(body, offsets, length, bits, ranges):
    """For each range the sorted fingerprints of a block, each value at most twice."""
    at, _ = sample_positions(offsets, length)
    values = np.sort(fingerprints(body, at, length) >> np.uint64(64 - bits))
    if len(values) > 2:
        values = values[np.concatenate([[True, True], values[2:] != values[:-2]])]
    cuts = np.searchsorted(values, _edges(bits, ranges))
    for r in range(ranges):
        if cuts[r] < cuts[r + 1]:
            yield r, values[cuts[r]:cuts[r + 1]]


def _edges(bits: int, ranges: int) -> np.ndarray:
    return np.array([-(-(r << bits) // ranges) for r in range(ranges)] + [1 << bits], np.uint64)


def cover_sample(blocks: DataFrame, length: int, bits: int, ranges: int, tables: _Tables, hot_blocks: int) -> DataFrame:
    """(range, block, shared, hot): fingerprints of the block that occur elsewhere too, and those of them that are hot (null if none is)."""
    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                body, offsets = np.frombuffer(row["body"], np.uint8), np.frombuffer(row["offsets"], np.int64)
                found = list(_sent(body, offsets, length, bits, ranges))
                yield pa.RecordBatch.from_pydict({
                    "range": pa.array([r for r, _ in found], pa.int32()), "block": pa.array([row["block"]] * len(found), pa.int64()),
                    "data": pa.array([pack_sorted(v) for _, v in found], pa.binary()),
                })

    def match(group: pa.Table) -> pa.Table:
        lists = [unpack_sorted(d, np.uint64) for d in group["data"].to_pylist()]
        own, hot = match_lists(lists, hot_blocks)
        hot_of = [_common(v, hot) for v in own] if len(hot) else [hot] * len(own)
        return pa.table({
            "range": group["range"], "block": group["block"], "shared": pa.array([pack_sorted(v) for v in own], pa.binary()),
            "hot": pa.array([pack_sorted(v) if len(v) else None for v in hot_of], pa.binary()),
        })

    sent = blocks.select("block", "offsets", "body").mapInArrow(send, "range int, block bigint, data binary")
    return tables.put(sent.repartitionById(ranges, F.col("range")).groupBy("range").applyInArrow(match, "range int, block bigint, shared binary, hot binary"))


def match_lists(lists: list[np.ndarray], hot_blocks: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Of each sorted list the values that are in the lists twice or more, once each; of all the values that are there more than ``hot_blocks`` times."""
    every = np.concatenate(lists)
    order = np.argsort(every, kind="stable")  # merges the sorted lists
    merged = every[order]
    new = np.ones(len(merged) + 1, bool)
    np.not_equal(merged[1:], merged[:-1], out=new[1:-1])
    keep = np.empty(len(every), bool)
    keep[order] = ~(new[:-1] & new[1:])
    ends = np.cumsum([len(v) for v in lists])
    again = every[1:] == every[:-1]
    again[(inner := ends[:-1])[(inner > 0) & (inner < len(every))] - 1] = False  # a list that begins with the value the one before ends with
    keep[1:] &= ~again
    kept = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], ends])]
    values = every[keep]
    first = np.flatnonzero(new)
    return [values[a:b] for a, b in zip(kept, kept[1:])], merged[first[:-1][np.diff(first) > hot_blocks]]


def _common(sorted_values: np.ndarray, among: np.ndarray) -> np.ndarray:
    values = np.unique(sorted_values)
    return values[among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values] if len(among) else values[:0]


# --- suffix buckets -----------------------------------------------------------------------------------------
class Contexts:
    """Cover-sample suffixes of a block that may tie with others, equal ones merged, in the order of their ranges.

    A row of ``windows`` has the PERIOD - 1 bytes before and the ``length`` bytes after each sample, zero outside the
    document, and last the lowest and the highest shift whose window lies in the document. ``range`` and ``doc`` are of these
    rows; ``at`` and ``later`` of the samples, ``counts`` of them to a row.
    """

    def __init__(self, body, offsets, ids, shared, hot, length, bits, ranges):
        before = PERIOD - 1
        at, doc = sample_positions(offsets, length)
        values = fingerprints(body, at, length) >> np.uint64(64 - bits)
        # What passes the bit set by chance only ties with nothing; hot ones are told apart exactly, by all blocks alike.
        is_hot = _member(values, hot)
        keep = np.flatnonzero(_bit_set(values, shared) | is_hot)
        at, doc, values, is_hot = at[keep], doc[keep], values[keep], is_hot[keep]
        low = np.maximum(0, length - (offsets[1:][doc] - at))
        high = np.minimum(before, at - offsets[:-1][doc])
        keep = np.flatnonzero(low <= high)
        if len(keep) < len(at):
            at, doc, values, low, high, is_hot = at[keep], doc[keep], values[keep], low[keep], high[keep], is_hot[keep]
        fixed = np.zeros(len(at), bool)
        if is_hot.any():
            split = np.flatnonzero(is_hot)
            rest = np.flatnonzero(~is_hot)
            shifts = [split[(low[split] <= k) & (k <= high[split])] for k in range(PERIOD)]
            taken = np.concatenate([rest, *shifts])
            fixed = np.arange(len(taken)) >= len(rest)
            at, doc, values, low, high = at[taken], doc[taken], values[taken], low[taken], high[taken]
            low[fixed] = high[fixed] = np.concatenate([np.full(len(s), k) for k, s in enumerate(shifts)])
        width = window_width(length)
        wide = np.concatenate([np.zeros(before, np.uint8), body, np.zeros(width - before, np.uint8)])
        windows = np.lib.stride_tricks.sliding_window_view(wide, width)[at]
        edge = np.flatnonzero((low > 0) | (high < before))
        column = np.arange(width)
        windows[edge] = np.where((column < before - high[edge, None]) | (column >= before + length - low[edge, None]), np.uint8(0), windows[edge])
        windows[:, before + length:] = 0
        windows[:, -2], windows[:, -1] = low, high
        code = mixed(windows.view("<u8").T) if len(windows) else np.zeros(0, np.uint64)
        # Range: of the fingerprint, or for hot ones of the window.
        where = np.searchsorted(_edges(bits, ranges), np.where(fixed, code >> np.uint64(64 - bits), values), "right") - 1
        room = np.uint64(ranges.bit_length())
        key = where.astype(np.uint64) << (np.uint64(64) - room) | code >> room
        order = np.argsort(key)
        windows = np.take(windows, order, axis=0)
        new = _new_rows(windows)
        first = np.flatnonzero(new)
        owner = ids[doc[order]]
        self.at, self.windows, self.range = at[order], windows[first], where[order[first]]
        self.counts = np.diff(np.append(first, len(order)))
        self.doc = np.minimum.reduceat(owner, first) if len(first) else owner
        self.later = owner > np.repeat(self.doc, self.counts)  # an earlier document of the block has the same context


def window_width(length: int) -> int:
    return -(-(PERIOD - 1 + length + 2) // 8) * 8


def _new_rows(rows: np.ndarray) -> np.ndarray:
    """Which of the byte rows, a multiple of 8 wide, differ from the row before."""
    new = np.ones(len(rows), bool)
    if len(rows) > 1:
        words = rows.view(np.uint64)
        new[1:] = (words[1:] != words[:-1]).any(axis=1)
    return new


def _bit_set(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values have the same bits as one of ``among`` in two bit sets: all of its members, and few others."""
    room = max(10, min(26, int(len(among) * 16).bit_length()))
    near = np.arange(len(values))
    for factor in (np.uint64(X.BASE), _MULTIPLIER):
        table = np.zeros(1 << room, bool)
        table[(among * factor >> np.uint64(64 - room)).view(np.int64)] = True
        near = near[table[(values[near] * factor >> np.uint64(64 - room)).view(np.int64)]]
    found = np.zeros(len(values), bool)
    found[near] = True
    return found


def _member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values are in the sorted ``among``: a bit set first, then a search for what passes."""
    found = np.zeros(len(values), bool)
    if len(among) and len(values):
        near = np.flatnonzero(_bit_set(values, among))
        found[near] = among[np.minimum(np.searchsorted(among, values[near]), len(among) - 1)] == values[near]
    return found


CONTEXT = pa.schema([("range", pa.int32()), ("block", pa.int64()), ("contexts", pa.int32()), ("members", pa.int32()), ("data", pa.binary())])


def _block_contexts(row, length, bits, ranges, chosen):
    """Rows of CONTEXT of one block, for the ranges ``chosen`` only, which are numbered by their places in it."""
    shared, hot = (np.concatenate([np.zeros(0, np.uint64), *(unpack_sorted(d, np.uint64) for d in row[c])]) for c in ("shared", "hot"))
    c = Contexts(np.frombuffer(row["body"], np.uint8), np.frombuffer(row["offsets"], np.int64), np.frombuffer(row["ids"], np.int64),
                 shared, np.sort(hot), length, bits, ranges)
    cuts = np.searchsorted(c.range, np.arange(ranges + 1))
    member_cuts = np.concatenate([[0], np.cumsum(c.counts)])[cuts]
    doc, counts, at, later = c.doc.view(np.uint64), c.counts.astype(np.uint32), c.at.astype(np.uint32), c.later.view(np.uint8)
    compress = _codecs()[0].compress
    for place, r in enumerate(chosen):
        a, b, x, y = cuts[r], cuts[r + 1], member_cuts[r], member_cuts[r + 1]
        if a < b:
            data = b"".join([c.windows[a:b].tobytes(), _planes(doc[a:b]), _planes(counts[a:b]), _planes(at[x:y]), later[x:y].tobytes()])
            yield {"range": place, "block": row["block"], "contexts": b - a, "members": y - x, "data": compress(data)}


def _unpacked(row: dict, width: int) -> tuple[np.ndarray, ...]:
    """Windows, documents, counts, positions and flags of a row of CONTEXT."""
    raw, n, m = np.frombuffer(_codecs()[1].decompress(row["data"]), np.uint8), row["contexts"], row["members"]
    cuts = np.cumsum([n * width, n * 8, n * 4, m * 4])
    windows, doc, counts, at, later = np.split(raw, cuts)
    return windows.reshape(-1, width), _unplaned(doc, np.uint64).view(np.int64), _unplaned(counts, np.uint32).astype(np.int64), _unplaned(at, np.uint32), later > 0


def _words(rows: np.ndarray) -> list[np.ndarray]:
    """Columns of byte rows as big-endian words, the most significant first."""
    padded = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    padded[:, :rows.shape[1]] = rows
    return list(padded.view(">u8").astype(np.uint64).T)


def ordered(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte rows, and for each place in it the bytes shared with the row before."""
    order = np.lexsort(_words(rows)[::-1])
    common = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[order[1:]] != rows[order[:-1]]
        common[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return order, common


def ranks_at(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each row by its first ``depth`` bytes; equal rows have equal ranks."""
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.cumsum(common < depth)
    return ranks


def sort_bucket(windows: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """For each context a bit mask of the shifts k whose suffix, ``length`` bytes from k before the sample, is
    also in a document with a smaller id."""
    masks = np.zeros(len(windows), np.uint32)
    if not len(windows):
        return masks
    # Equal windows are one for all shifts: only their smallest document is sorted. The hash brings them together, the bytes decide.
    by_code = np.argsort(mixed(windows.view("<u8").T))
    gathered = np.take(windows, by_code, axis=0)
    first = np.flatnonzero(_new_rows(gathered))
    sizes = np.diff(np.append(first, len(by_code)))
    owner = np.minimum.reduceat(doc[by_code], first)
    distinct = gathered[first]
    del gathered
    later = doc[by_code] > np.repeat(owner, sizes)
    masks[by_code] = np.where(later, np.repeat(whole_masks(distinct), sizes), np.repeat(_tied(distinct, owner, length), sizes))
    return masks


def whole_masks(windows: np.ndarray) -> np.ndarray:
    """All shifts of each window as bit masks."""
    low, high = windows[:, -2].astype(np.uint64), windows[:, -1].astype(np.uint64)
    return ((np.uint64(2) << high) - (np.uint64(1) << low)).astype(np.uint32)


def _tied(windows: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """``sort_bucket`` of windows that differ."""
    before, masks = PERIOD - 1, np.zeros(len(windows), np.uint32)
    # Only windows whose first bytes after the sample occur twice can tie.
    code = mixed(_words(windows[:, before:before + length - before]))
    by_code = np.argsort(code)
    same = np.zeros(len(code) + 1, bool)
    same[1:-1] = code[by_code[1:]] == code[by_code[:-1]]
    left = np.sort(by_code[same[1:] | same[:-1]])
    # A shift k takes length - k bytes that another one shares after the sample, and k before it.
    low, high = windows[left, -2].astype(np.int64), windows[left, -1].astype(np.int64)
    order, common = ordered(windows[left, before:before + length])
    low = np.maximum(low, length - _most_common(order, common))
    keep = np.flatnonzero(low <= high)
    left, low, high = left[keep], low[keep], high[keep]
    order, common = _among(order, common, keep)
    left_order, left_common = ordered(windows[left, :before][:, ::-1])
    high = np.minimum(high, _most_common(left_order, left_common))
    for k in range(PERIOD):
        fits = np.flatnonzero((low <= k) & (k <= high))
        if len(fits) < 2:
            continue
        # The k bytes before the sample decide, then the rank of the sample suffix at the depth that is left.
        key = ranks_at(left_order, left_common, k)[fits] * (len(left) + 1) + ranks_at(order, common, length - k)[fits]
        sorted_at = np.argsort(key)
        key, owner = key[sorted_at], doc[left[fits[sorted_at]]]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        smallest = np.repeat(np.minimum.reduceat(owner, first), np.diff(np.append(first, len(key))))
        masks[left[fits[sorted_at[owner > smallest]]]] |= np.uint32(1 << k)
    return masks


def _most_common(order: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The most bytes that each row shares with any other."""
    most = np.empty(len(order), np.int64)
    most[order] = np.maximum(common, np.append(common[1:], 0)) if len(order) else common
    return most


def _among(order: np.ndarray, common: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows ``keep``, and the bytes that each shares with the one kept before it: the least on the way."""
    number = np.full(len(order), -1)
    number[keep] = np.arange(len(keep))
    places = np.flatnonzero(number[order] >= 0)
    if not len(places):
        return places, common[:0]
    least = np.minimum.reduceat(common[:places[-1] + 1], np.append(0, places[:-1] + 1))
    least[0] = 0
    return number[order[places]], least


def suffix_buckets(with_shared: DataFrame, length: int, bits: int, ranges: int, chosen: list[int], tables: _Tables) -> DataFrame:
    """(block, hits, data): the repeats of the buckets ``chosen``, as sample positions and bit masks of shifts."""
    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                found = list(_block_contexts(row, length, bits, ranges, chosen))
                yield pa.RecordBatch.from_pylist(found, schema=CONTEXT)

    def sort(group: pa.Table) -> pa.Table:
        rows, width, start = group.select(["block", "contexts", "members"]).to_pylist(), window_width(length), 0
        total = sum(r["contexts"] for r in rows)
        windows, doc, members = np.empty((total, width), np.uint8), np.empty(total, np.int64), []
        for r, data in zip(rows, group["data"]):
            end = start + r["contexts"]
            windows[start:end], doc[start:end], *rest = _unpacked(r | {"data": data.as_py()}, width)
            members.append(rest)
            start = end
        masks, whole, out, start = sort_bucket(windows, doc, length), whole_masks(windows), [], 0
        for r, (counts, at, later) in zip(rows, members):
            end = start + r["contexts"]
            mask = np.where(later, np.repeat(whole[start:end], counts), np.repeat(masks[start:end], counts))
            hits = np.flatnonzero(mask)
            if len(hits):
                out.append((r["block"], len(hits), pack_hits(at[hits], mask[hits])))
            start = end
        blocks, hits, data = zip(*out) if out else ((), (), ())
        return pa.table({"block": pa.array(blocks, pa.int64()), "hits": pa.array(hits, pa.int32()), "data": pa.array(data, pa.binary())})

    kinds = {pa.int32(): "int", pa.int64(): "bigint", pa.binary(): "binary"}
    sent = with_shared.mapInArrow(send, ", ".join(f"{f.name} {kinds[f.type]}" for f in CONTEXT))
    return tables.put(sent.repartitionById(len(chosen), F.col("range")).groupBy("range").applyInArrow(sort, "block bigint, hits int, data binary"))


def pack_hits(at: np.ndarray, mask: np.ndarray) -> bytes:
    order = np.argsort(at)
    return _codecs()[0].compress(_planes(np.diff(at[order], prepend=at.dtype.type(0))) + _planes(mask[order]))


def unpack_hits(data: bytes, hits: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(_codecs()[1].decompress(data), np.uint8)
    return np.cumsum(_unplaned(raw[:4 * hits], np.uint32), dtype=np.uint32), _unplaned(raw[4 * hits:], np.uint32)


# --- removal ------------------------------------------------------------------------------------------------
def covered(n: int, repeats: list[tuple[np.ndarray, np.ndarray]], length: int) -> np.ndarray:
    """Which of ``n`` bytes lie in a repeat."""
    starts = np.zeros(n + 1, bool)
    if repeats:
        at, mask = (np.concatenate(x) for x in zip(*repeats))
        at = at.astype(np.int64)
        for k in range(PERIOD):
            starts[at[(mask >> np.uint32(k) & np.uint32(1)) > 0] - k] = True
    steps = np.zeros(n + 1, np.int32)
    first = np.flatnonzero(starts)
    steps[first] += 1
    np.add.at(steps, np.minimum(first + length, n), -1)
    return np.cumsum(steps[:n]) > 0


def whole_characters(kept: bytes) -> str:
    """Text of the remaining bytes, without the stumps of characters that were cut."""
    return kept.decode("utf-8", "ignore")


def _cut(blocks: DataFrame, length: int, fields: list, with_text: bool) -> DataFrame:
    digest = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept string" * with_text
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), digest])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                body, offsets = np.frombuffer(row["body"], np.uint8), np.frombuffer(row["offsets"], np.int64)
                gone = covered(len(body), [unpack_hits(x["data"], x["hits"]) for x in row["found"] or []], length)
                edge = gone.copy()
                edge[1:] &= ~gone[:-1]
                heads = offsets[:-1][offsets[:-1] < len(gone)]
                edge[heads] = gone[heads]
                n = np.diff(offsets)
                totals = [np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in (gone, edge)]
                removed, spans = (t[offsets[1:]] - t[offsets[:-1]] for t in totals)
                kept = [body[a:b][~gone[a:b]].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
                rest = pa.ipc.open_stream(row["rest"]).read_all().combine_chunks().to_batches()
                columns = list(rest[0].columns) if rest else []
                columns += [pa.array(n), pa.array(removed), pa.array(spans), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
                if with_text:
                    columns.append(pa.array([whole_characters(x) for x in kept], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in fields), "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text])

    return blocks.mapInArrow(run, schema)


def remove_repeats(documents: DataFrame, length: int = LENGTH, carry: tuple[str, ...] = (), with_text: bool = True, hot_blocks: int = HOT_BLOCKS,
                   block_bytes: int = BLOCK_BYTES, range_samples: int = RANGE_SAMPLES) -> DataFrame:
    """(doc_id, ``carry``, n_bytes, n_removed, n_spans, kept_sha256, kept) for each row of ``documents``.

    Every byte goes that is covered by a string of ``length`` bytes which also starts in a document with a
    smaller doc_id; strings are judged on the input. ``kept_sha256`` is of the remaining bytes, ``kept`` their
    text without cut characters. Null texts count as empty. Rows with one doc_id don't remove each other; rows
    without doc_id come after all others. ``length`` is at least 40.
    """
    if length < PERIOD + 19:
        raise ValueError("strings are at least 40 bytes long")
    spark = documents.sparkSession
    shared_folder(spark)
    rows = pick(documents, doc_id="doc_id", text="text", **{f"carry_{i}": c for i, c in enumerate(carry)})
    fields = [f for f in rows.schema.fields if f.name != "text"]
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    samples = max(1, n_bytes * len(COVER) // PERIOD)
    bits, ranges = min(60, 24 if samples < 1 << 18 else samples.bit_length() + SPARE_BITS), math.ceil(samples / range_samples)
    tables = _Tables(spark)
    try:
        # The text stays in its buckets; what is sent back for a block is shuffled to them.
        buckets = math.ceil(max(1, n_bytes) / (6 * block_bytes))
        blocks = tables.put(_blocks(rows, block_bytes), "block", buckets)
        known = cover_sample(blocks, length, bits, ranges, tables, hot_blocks)
        found = []
        for turn in range(min(PASSES, ranges)):
            own = F.col("range") % PASSES == turn
            lists = known.where(own | F.col("hot").isNotNull()).repartition(buckets, "block").groupBy("block").agg(
                F.collect_list(F.when(own, F.col("shared"))).alias("shared"), F.collect_list("hot").alias("hot"))
            with_shared = blocks.select("block", "ids", "offsets", "body").join(lists.hint("shuffle_hash"), "block")
            # Each range is sorted in PASSES buckets.
            chosen = [r for r in range(ranges * PASSES) if r // PASSES % PASSES == turn]
            found.append(suffix_buckets(with_shared, length, bits, ranges * PASSES, chosen, tables))
        tables.drop(known)
        repeats = reduce(DataFrame.unionAll, found).repartition(buckets, "block").groupBy("block").agg(F.collect_list(F.struct("hits", "data")).alias("found"))
        joined = blocks.select("block", "offsets", "body", "rest").join(repeats.hint("shuffle_hash"), "block", "left")
        cut = _cut(joined.select("offsets", "body", "rest", "found"), length, fields, with_text)
        with _shuffles_cleaned(spark):
            return materialise(cut).withColumnsRenamed({f"carry_{i}": c for i, c in enumerate(carry)})
    finally:
        tables.drop()
