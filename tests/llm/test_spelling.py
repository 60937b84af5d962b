"""Spelling variants against a plain version of their contract."""

import re
from collections import Counter
from itertools import combinations
from zlib import crc32

import numpy as np
import pytest

from bedtide.llm import spelling

SCHEMA = "doc_id bigint, text string, `TEXT` string, n int"


def near(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(rows, least=3):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= least}
    links = {w: [] for w in words}
    for a, b in combinations(sorted(words), 2):
        if near(a, b):
            links[a].append(b)
            links[b].append(a)
    forms = {}
    for w, others in links.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        forms[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        return w if forms[w] is None else root(forms[w])

    return sorted((w, forms[w] or "", root(w), n, len(links[w]), words[forms[w]] if forms[w] else 0) for w, n in words.items())


def found(frame):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in spelling.spelling_variants(frame).collect())


def texts():
    rng = np.random.default_rng(5)
    base = ["colour", "color", "colors", "grüßen", "grüssen", "Éclair", "éclair", "modelling", "modeling", "aaaaa", "aaaaaa", "aaaaaaa", "aaaaaaaa", "abcde" * 30, "abcde" * 30 + "x", "ab×cd", "ÿÿÿÿÿ"]
    rows = []
    for i in range(400):
        words = []
        for w in rng.choice(base, 12, p=np.arange(len(base), 0, -1) / sum(range(len(base) + 1))):
            if rng.random() < 0.3:
                at = int(rng.integers(len(w)))
                w = w[:at] + str(rng.choice(["", "x", "é", w[at] + w[at]])) + w[at + 1:]
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i if i % 50 else None, (" ", ", ", "\n", "1")[i % 4].join(words)))
    return rows


@pytest.mark.parametrize("tile_words", [2, spelling.TILE_WORDS])
def test_equals_plain_version(spark, monkeypatch, tile_words):
    monkeypatch.setattr(spelling, "TILE_WORDS", tile_words)
    rows = texts()
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    want = plain(rows)
    assert found(frame) == want and any(r[1] for r in want) and any(r[2] not in (r[0], r[1]) for r in want)


def test_long_words_and_empty_tables(spark):
    long = "Word" * 50000
    rows = [(1, None), (2, ""), (3, "!! 12 3"), (None, None), (4, long), (5, long), (6, long), (7, long + "s"), (7, long + "s " + long + "s"), (8, "kurz " * 70000)]
    got = found(spark.createDataFrame([(d, t, None, None) for d, t in rows], SCHEMA))
    assert [(len(w), n) for w, _, _, n, _, _ in got] == [(200000, 3), (200001, 3)] and all(r[4] == 1 and not r[1] for r in got)
    assert found(spark.createDataFrame([], SCHEMA)) == []


def test_gram_candidates_miss_no_near_pair():
    rng = np.random.default_rng(1)
    for size in (5, 6, 9):
        a = rng.integers(0x61, 0x64, (150, size)).astype(np.uint8)
        for b in (a, rng.integers(0x61, 0x64, (150, size + 1)).astype(np.uint8)):
            same = b is a
            text = lambda m: [r.tobytes().decode("latin-1") for r in m]
            want = {(i, j) for i, x in enumerate(text(a)) for j, y in enumerate(text(b)) if near(x, y) and (i < j or not same)}
            assert set(zip(*(x.tolist() for x in spelling.near_pairs(a, b, same)))) == want and want
