"""Distinct byte strings among spans of a text: work on them is done once and dealt back to all places."""

from __future__ import annotations

import numpy as np

from bedtide.llm import text as X

WIDE = 16  # bytes that two numbers hold
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def flat(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices starts[0], starts[0] + 1, ..., of all spans one after another."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def ends_as_numbers(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last eight bytes of each span as numbers; of a shorter span both are its bytes."""
    padded = np.zeros(len(body) + 8, np.uint8)
    padded[:len(body)] = body
    numbers = np.ndarray(len(body) + 1, "<u8", padded, strides=(1,))
    mask = _MASKS[np.minimum(ends - starts, 8)]
    return numbers[starts] & mask, numbers[np.maximum(starts, ends - 8)] & mask


def distinct(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indices of the first span of each distinct string, for each span which of them it equals).

    Spans are told apart by a 64-bit hash and then compared byte by byte; should two strings ever share a hash,
    every span counts as distinct.
    """
    sizes = ends - starts
    head, tail = ends_as_numbers(body, starts, ends)
    key = X.mix(X.mix(head + sizes.astype(np.uint64) * np.uint64(X.BASE)) + tail)
    long = np.flatnonzero(sizes > WIDE)
    text = body[flat(starts[long], sizes[long])]
    after = np.cumsum(sizes[long])
    key[long] = X.mix(key[long] + X.span_hashes(text, after - sizes[long], after))
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    same = first[which]
    if all(np.array_equal(x, x[same]) for x in (sizes, head, tail)) and np.array_equal(text, body[flat(starts[same[long]], sizes[long])]):
        return first, which
    return np.arange(len(starts)), np.arange(len(starts))


def strings(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    blob = body.tobytes()
    return [blob[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def slices(starts: np.ndarray, ends: np.ndarray, limit: int = X.CHUNK_BYTES):
    """Runs of spans that lie within about ``limit`` bytes (one longer span stands alone)."""
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + limit, "right")))
        yield first, last
        first = last
