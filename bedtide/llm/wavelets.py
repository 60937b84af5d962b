"""Token ids of a corpus in files of wavelet matrices.

Texts are encoded by the ``tokenizers`` library and end with an end id. In ascending doc_id order the ids are cut, between
documents, into shards of some millions. A shard is one Parquet file of one row: the documents' ids and sizes, and
for each bit of an id, the highest first, a plane of bits with the number of ones before every 512th. After a plane
the ids are dealt stably, those with a 0 before those with a 1, and the next plane is of that order. Rank on the planes
gives any single id, how often an id occurs in a range, and, with select, where.
"""

from __future__ import annotations

import os
from array import array
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bedtide.llm import spans
from bedtide.llm import text as X
from bedtide.llm.frames import pick
from bedtide.session import scratch_path

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
SHARD_TOKENS = 1 << 22
BYTES_PER_TOKEN = 3  # about; sets the number of ranges only
BLOCK = 512  # bits between two counts of a plane
HELD_PIECES = 600_000  # distinct pieces whose ids a worker remembers
COLUMNS = ["shard", "n_tokens", "doc_ids", "sizes", "zeros", "planes", "counts"]


# --- tokens ------------------------------------------------------------------------------------------------
@cache
def tokenizer(path: str | None = None):
    from tokenizers import Tokenizer

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True  # the strings of special tokens in a text are text
    return found


_HELD: dict[bytes, bytes] = {}
_BLANK, _BREAK, _MARK = 1, 2, 3
_KIND = np.array([_BLANK if b == 0x20 else _BREAK if b == 0x0A else _MARK if 0x21 <= b <= 0x7E and not chr(b).isalnum() and b != 0x27 else 0 for b in range(256)], np.uint8)
_LETTER = X.byte_class(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)
_GRAPHIC = X.byte_class(lambda b: 0x21 <= b <= 0x7E)
_LEAD = X.byte_class(lambda b: 0xC3 <= b <= 0xDF)  # of characters of two bytes, none of them white space


def cuts(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of pieces whose tokens don't depend on what is around them.

    Byte-level BPE first splits into words with at most one blank before them, numbers, runs of marks, and white space. A word
    always begins at a single blank between two visible characters, ends before an ASCII mark other than the apostrophe, and a single
    line break between visible ASCII characters stands alone. Cuts are made there and nowhere else, and where texts meet.
    """
    kind = _KIND[body]
    around = np.zeros(len(body) + 4, np.uint8)
    around[2:-2] = body
    before2, before, after = around[:-4], around[1:-3], around[3:-1]
    cut = np.zeros(len(body) + 1, bool)
    at = np.flatnonzero(kind == _BLANK)
    seen = _GRAPHIC[before[at]] | (_LEAD[before2[at]] & (before[at] >= 0x80))
    cut[at[seen & (_GRAPHIC | _LEAD)[after[at]]]] = True
    at = np.flatnonzero(kind == _MARK)
    cut[at[_LETTER[before[at]]]] = True
    at = np.flatnonzero(kind == _BREAK)
    at = at[_GRAPHIC[before[at]] & _GRAPHIC[after[at]]]
    cut[at] = True
    cut[at + 1] = True
    cut[offsets] = True
    places = np.flatnonzero(cut)
    return places[:-1], places[1:]


def token_ids(body: np.ndarray, offsets: np.ndarray, path: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, and the number of ids of each."""
    starts, ends = cuts(body, offsets)
    owner = np.searchsorted(offsets[1:], starts, "right")
    parts, sizes = [np.zeros(0, np.uint32)], np.zeros(len(offsets) - 1, np.int64)
    for a, b in spans.slices(starts, ends):
        some, low, high = body[starts[a]:ends[b - 1]], starts[a:b] - starts[a], ends[a:b] - starts[a]
        first, which = spans.distinct(some, low, high)
        pieces = spans.strings(some, low[first], high[first])
        if len(_HELD) > HELD_PIECES:
            _HELD.clear()
        new = [p for p in pieces if p not in _HELD]
        for p, found in zip(new, tokenizer(path).encode_batch_fast([p.decode() for p in new], add_special_tokens=False)):
            _HELD[p] = array("I", found.ids).tobytes()
        held = [_HELD[p] for p in pieces]
        number = np.array([len(h) >> 2 for h in held], np.int64)
        begin = np.cumsum(number) - number
        parts.append(np.frombuffer(b"".join(held), np.uint32)[spans.flat(begin[which], number[which])])
        sizes += np.bincount(owner[a:b], number[which], len(sizes)).astype(np.int64)
    return np.concatenate(parts), sizes


def with_end(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end_id`` after each text."""
    return np.insert(ids, np.cumsum(sizes), end_id), sizes + 1


# --- the wavelet matrix --------------------------------------------------------------------------------------
def build(ids: np.ndarray, bits: int) -> tuple[list[bytes], list[bytes], list[int]]:
    """Planes, their counts of ones before every block, and their numbers of zeros."""
    planes, counts, zeros = [], [], []
    order = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    for k in range(bits - 1, -1, -1):
        bit = (order >> k & 1).astype(bool)
        packed = np.packbits(bit, bitorder="little")
        padded = np.zeros(-(-max(len(bit), 1) // BLOCK) * (BLOCK // 64), np.uint64)
        padded.view(np.uint8)[:len(packed)] = packed
        ones = np.bitwise_count(padded).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint32)
        planes.append(padded.tobytes())
        counts.append((np.cumsum(ones, dtype=np.uint32) - ones).tobytes())
        zeros.append(int(len(bit) - ones.sum()))
        order = np.concatenate([order[~bit], order[bit]])
    return planes, counts, zeros


class WaveletMatrix:
    """A shard's ids, read from its planes."""

    def __init__(self, n: int, planes: list[bytes], counts: list[bytes], zeros: list[int]):
        self.n, self.zeros = n, list(zeros)
        self.planes = [np.frombuffer(p, np.uint8) for p in planes]
        self.counts = [np.frombuffer(c, np.uint32) for c in counts]

    def ones(self, k: int, at: np.ndarray) -> np.ndarray:
        """Ones of plane ``k`` before each place."""
        at = np.asarray(at, np.int64)
        block = np.minimum(at // BLOCK, len(self.counts[k]) - 1)
        words = self.planes[k].view(np.uint64).reshape(-1, BLOCK // 64)[block]
        left = at[..., None] - block[..., None] * BLOCK - np.arange(BLOCK // 64) * 64
        shift = (64 - np.clip(left, 0, 64)).astype(np.uint64)
        inside = np.where(shift < 64, words << np.minimum(shift, np.uint64(63)), np.uint64(0))
        return self.counts[k][block].astype(np.int64) + np.bitwise_count(inside).sum(axis=-1, dtype=np.int64)

    def _bit(self, k: int, at: np.ndarray) -> np.ndarray:
        return self.planes[k][at >> 3] >> (at & 7).astype(np.uint8) & 1

    def _select(self, k: int, bit: int, nth: np.ndarray) -> np.ndarray:
        """Place of the nth (from 0) zero or one of plane ``k``, by halving over its rank."""
        low, high = np.zeros(len(nth), np.int64), np.full(len(nth), self.n, np.int64)
        while (low < high).any():
            mid = (low + high) // 2
            ones = self.ones(k, mid + 1)
            enough = (ones if bit else mid + 1 - ones) > nth
            low, high = np.where(enough, low, np.minimum(mid + 1, high)), np.where(enough, mid, high)
        return low

    def access(self, at) -> np.ndarray:
        """The ids at the given places."""
        at = np.asarray(at, np.int64)
        value = np.zeros(len(at), np.uint32)
        for k, zeros in enumerate(self.zeros):
            bit, ones = self._bit(k, at), self.ones(k, at)
            value = value << 1 | bit
            at = np.where(bit == 1, zeros + ones, at - ones)
        return value

    def _range(self, token: int, low, high) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.asarray(low, np.int64), np.asarray(high, np.int64)
        if token >> len(self.zeros):
            return low, low
        for k, zeros in enumerate(self.zeros):
            below, above = self.ones(k, low), self.ones(k, high)
            bit = token >> (len(self.zeros) - 1 - k) & 1
            low, high = (zeros + below, zeros + above) if bit else (low - below, high - above)
        return low, high

    def count(self, token: int, low, high) -> np.ndarray:
        """How often ``token`` occurs in each range of places."""
        low, high = self._range(token, low, high)
        return high - low

    def places(self, token: int, low: int = 0, high: int | None = None) -> np.ndarray:
        """All places of ``token`` in a range, in order: found at the end of the planes and led back by select."""
        first, last = self._range(token, [low], [self.n if high is None else high])
        at = np.arange(int(first[0]), int(last[0]))
        for k in range(len(self.zeros) - 1, -1, -1):
            bit = token >> (len(self.zeros) - 1 - k) & 1
            at = self._select(k, bit, at - self.zeros[k] if bit else at)
        return at

    def all(self) -> np.ndarray:
        """All ids in order: the planes undone from the last to the first."""
        value = np.zeros(self.n, np.uint32)
        for k in range(len(self.zeros) - 1, -1, -1):
            bit = np.unpackbits(self.planes[k], count=self.n, bitorder="little").astype(bool)
            back = np.empty(self.n, np.uint32)
            back[~bit] = value[:self.zeros[k]]
            back[bit] = value[self.zeros[k]:] | np.uint32(1 << (len(self.zeros) - 1 - k))
            value = back
        return value


# --- files ---------------------------------------------------------------------------------------------------
def shards(documents: DataFrame, tokenizer_path: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(shard, n_tokens, doc_ids, sizes, zeros, planes, counts), shards in the order of doc_id.

    Documents are dealt out by ranges of doc_id; where many rows share one, by their place in the table too.
    """
    rows = pick(documents, doc_id="doc_id", text="text").withColumn("row", F.monotonically_increasing_id())
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    ordered = rows.repartitionByRange(max(1, -(-size // (BYTES_PER_TOKEN * shard_tokens))), "doc_id", "row").sortWithinPartitions("doc_id", "row")
    kind = rows.schema["doc_id"].dataType.simpleString()
    bits = max(tokenizer(tokenizer_path).get_vocab_size() - 1, end_id, 1).bit_length()

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        first, number = TaskContext.get().partitionId() << 32, 0
        names, sizes, ids, id_type = [], [], [], None

        def shard():
            found = np.concatenate(ids)
            planes, counts, zeros = build(found, bits)
            one = lambda values, kind: pa.array([values], pa.list_(kind))
            return pa.RecordBatch.from_arrays([
                pa.array([first + number], pa.int64()), pa.array([len(found)], pa.int64()), one(names, id_type), one(sizes, pa.int32()),
                one(zeros, pa.int64()), one(planes, pa.binary()), one(counts, pa.binary()),
            ], names=COLUMNS)

        for batch in batches:
            id_type = batch.column(0).type
            for part, body, offsets in X.chunks(batch):
                found, length = with_end(*token_ids(body, offsets, tokenizer_path), end_id)
                names += part.column(0).to_pylist()
                sizes += length.tolist()
                ids.append(found.astype(np.uint16 if bits <= 16 else np.uint32))
                if sum(map(len, ids)) >= shard_tokens:
                    yield shard()
                    names, sizes, ids, number = [], [], [], number + 1
        if names:
            yield shard()

    return ordered.select("doc_id", "text").mapInArrow(
        run, f"shard bigint, n_tokens bigint, doc_ids array<{kind}>, sizes array<int>, zeros array<bigint>, planes array<binary>, counts array<binary>")


def write_shards(documents: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode ``documents`` (doc_id, text) and write their shards to the folder ``path``, a file each.

    Null and empty texts have the end id alone; rows without doc_id come first; rows of one doc_id keep the order in which
    they were read; an empty table gives an empty folder of shards. Other columns are not read. A document is never cut, and some
    megabytes of documents are encoded at once, so a shard may exceed ``shard_tokens`` by those.
    """
    shards(documents, tokenizer_path, end_id, shard_tokens).write.option("maxRecordsPerFile", 1).option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def begins(shards: DataFrame) -> DataFrame:
    """(shard, start, n_tokens): the place of each shard's first id in the whole corpus. One row stands for millions of ids."""
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return shards.select("shard", F.coalesce(before, F.lit(0)).alias("start"), "n_tokens")


def _each(shards: DataFrame, found, schema: str) -> DataFrame:
    """``found(matrix, doc_ids, bounds, asked)`` of every shard, as rows of ``schema`` behind the shard's number. Planes stay where
    they are read; ``asked`` is the shard's column of that name, if it has one."""
    columns = ["shard", "n_tokens", "doc_ids", "sizes", "zeros", "planes", "counts", *(c for c in shards.columns if c == "asked")]

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                shard, n, ids, sizes, zeros, planes, counts, *asked = (batch.column(c)[r] for c in range(batch.num_columns))
                matrix = WaveletMatrix(n.as_py(), planes.as_py(), counts.as_py(), zeros.as_py())
                bounds = np.concatenate([[0], np.cumsum(sizes.values.to_numpy(), dtype=np.int64)])
                rows = found(matrix, ids.values, bounds, *asked)
                size = len(next(iter(rows.values())))
                yield pa.RecordBatch.from_pydict({"shard": pa.array(np.full(size, shard.as_py(), np.int64)), **rows})

    return shards.select(*columns).mapInArrow(run, f"shard bigint, {schema}")


def _in_corpus(rows: DataFrame, shards: DataFrame, place: str) -> DataFrame:
    """``rows`` with ``place``, counted from the shard's beginning, counted from the corpus's."""
    return rows.join(begins(shards).select("shard", F.col("start").alias("_start")), "shard").withColumn(place, F.col(place) + F.col("_start")).drop("shard", "_start")


def _id_type(shards: DataFrame) -> str:
    return shards.schema["doc_ids"].dataType.elementType.simpleString()


def document_table(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the planes."""
    def found(matrix, doc_ids, bounds):
        ids = memoryview(matrix.all().astype("<u4")).cast("B")
        sums = [crc32(ids[4 * a:4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        return {"doc_id": doc_ids, "start": pa.array(bounds[:-1]), "n_tokens": pa.array(np.diff(bounds)), "ids_crc32": pa.array(sums, pa.int64())}

    return _in_corpus(_each(shards, found, f"doc_id {_id_type(shards)}, start bigint, n_tokens bigint, ids_crc32 bigint"), shards, "start")


def occurrences(shards: DataFrame, token: int) -> DataFrame:
    """(doc_id, position, place) of each occurrence of ``token``: its position in the document and in the corpus."""
    def found(matrix, doc_ids, bounds):
        at = matrix.places(token)
        owner = np.searchsorted(bounds, at, "right") - 1
        return {"doc_id": doc_ids.take(pa.array(owner)), "position": pa.array(at - bounds[owner]), "place": pa.array(at)}

    return _in_corpus(_each(shards, found, f"doc_id {_id_type(shards)}, position bigint, place bigint"), shards, "place")


def token_frequency(shards: DataFrame, token: int) -> DataFrame:
    """(doc_id, n) of the documents that have ``token``: two ranks a plane for each document."""
    def found(matrix, doc_ids, bounds):
        n = matrix.count(token, bounds[:-1], bounds[1:])
        some = np.flatnonzero(n)
        return {"doc_id": doc_ids.take(pa.array(some)), "n": pa.array(n[some])}

    return _each(shards, found, f"doc_id {_id_type(shards)}, n bigint").drop("shard")


def tokens_at(shards: DataFrame, places: list[int]) -> DataFrame:
    """(place, token) of the ids at the given places of the corpus; a place beyond its end has no row. Shards without any of the
    places are not opened."""
    wanted = F.explode(F.array(*[F.lit(int(p)).cast("bigint") for p in sorted(set(places))])).alias("place")
    inside = (F.col("place") >= F.col("start")) & (F.col("place") < F.col("start") + F.col("n_tokens"))
    asked = begins(shards).select("shard", "start", "n_tokens", wanted).where(inside).groupBy("shard").agg(F.collect_set(F.col("place") - F.col("start")).alias("asked"))

    def found(matrix, doc_ids, bounds, asked):
        here = np.sort(asked.values.to_numpy())
        return {"place": pa.array(here), "token": pa.array(matrix.access(here).astype(np.int64))}

    return _in_corpus(_each(shards.join(F.broadcast(asked), "shard"), found, "place bigint, token bigint"), shards, "place")


def token_files(documents: DataFrame, tokenizer_path: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """``document_table`` of the shards of ``documents``, written to the shared folder and read back."""
    path = scratch_path(documents.sparkSession, "shards")
    write_shards(documents, path, tokenizer_path, end_id, shard_tokens)
    return document_table(read_shards(documents.sparkSession, path))
