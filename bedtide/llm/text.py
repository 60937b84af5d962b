"""Texts of an Arrow batch as one byte array, and words in it, with numpy.

All word classes of this package are classes of single UTF-8 bytes, so words are found on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 4 << 20


def byte_class(member) -> np.ndarray:
    return np.array([member(b) for b in range(256)])


# [^\x20\x09-\x0D]: anything but ASCII white space.
UNSPACED = byte_class(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
# [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing: digits, a-z and all beyond ASCII.
PLAIN = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)

# Multipliers of the mixing function of splitmix64 (fixed values).
MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column, end to end, and the n + 1 offsets; null counts as empty."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    width = np.int64 if wide else np.int32
    _, at, data = column.buffers()
    if at is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(at, width)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batch in slices of about ``limit`` bytes of text (one longer text stands alone)."""
    body, offsets = string_bytes(batch.column(batch.schema.get_field_index(column)))
    first, n = 0, batch.num_rows
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield (batch.slice(first, last - first), body[offsets[first]:offsets[last]],
               offsets[first:last + 1] - offsets[first])
        first = last


def word_bounds(body: np.ndarray, offsets: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the index of its first word (n + 1 of them)."""
    inside = np.zeros(len(body) + 2, bool)
    inside[1:-1] = members[body]
    starts, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(body))]
    starts[edges] |= inside[1:-1][edges]
    ends[edges - 1] |= inside[1:-1][edges - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX[0]
    h = (h ^ (h >> np.uint64(27))) * MIX[1]
    return h ^ (h >> np.uint64(31))


def span_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of body[start:end] for each span; equal bytes have equal hashes everywhere."""
    power, inverse = _powers(len(body) + 1)
    total = np.zeros(len(body) + 1, np.uint64)
    np.cumsum((body.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts])


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = mix((h ^ words[i:i + n]) + np.uint64(BASE))
    return h
