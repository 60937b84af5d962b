"""Importance resampling against plain Python; its query's SQL is compared in test_sql."""

import re
from collections import Counter
from hashlib import sha256
from math import floor, log
from zlib import crc32

import numpy as np
import pytest

from bedtide.llm import resampling
from bedtide.llm.resampling import resample

SCHEMA = "doc_id bigint, text string, `Text` string, rank int"


def plain_words(text):
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(upper, upper.lower())))


def features(text, low, high, buckets):
    words = plain_words(text)
    return Counter(crc32(" ".join(words[i:i + k]).encode()) % buckets for k in range(low, high + 1) for i in range(len(words) - k + 1))


def plain(rows, target, low, high, buckets, share, least):
    docs = [(d, features(t, low, high, buckets), len(plain_words(t))) for d, t in rows]
    s, t = sum((f for _, f, _ in docs), Counter()), sum((features(x, low, high, buckets) for x in target), Counter())
    ss, tt = sum(s.values()), sum(t.values())
    gain = lambda b: floor(1000 * log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets))))
    out = []
    for d, f, n in docs:
        weight = sum(gain(b) * k for b, k in f.items()) // sum(f.values()) if f else 0
        h = int(sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, n, sum(f.values()), weight, weight + floor(-1000 * log(-log((h + 0.5) / 4294967296)))])
    enough = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    ranks = Counter()
    for i, r in enumerate(enough[:len(enough) * share[0] // share[1]], 1):
        ranks[id(r)] = i
    return sorted((str(r[0]), *r[1:], ranks[id(r)]) for r in out)


def texts():
    rng = np.random.default_rng(2)
    words = ["Haus", "tree", "naïve", "日本", "x1", "ÀB", "Zoo"] + [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(0, 30))))) for i in range(120)]
    return rows + [(3, rows[3][1]), (None, "Haus tree " * 9), (200, None), (201, ""), (202, " \n--"), (203, "Haus," * 40000), (204, "a" * 300000), (205, "don't x-ray a\tb c\x00d")]


@pytest.mark.parametrize("window,buckets,share,least", [((1, 1), 10000, (10, 100), 20), ((1, 2), 97, (1, 3), 5), ((2, 3), 1000, (1, 1), 0)])
def test_equals_plain_version(spark, window, buckets, share, least):
    target = ["Haus tree Haus", None, "", "naïve Zoo w1 w2 w3"]
    rows = texts()
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    wanted = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(target)], SCHEMA.replace("doc_id", "item_id"))
    got = sorted((str(r.doc_id), r.n_words, r.n_features, r.weight, r.score, r["rank"] or 0) for r in resample(frame, wanted, window, buckets, share, least).collect())
    assert got == plain(rows, target, *window, buckets, share, least)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    items = empty.withColumnRenamed("doc_id", "item_id")
    assert resample(empty, items).count() == 0
    rows = resample(spark.createDataFrame([(1, "one two", None, None), (1, None, None, None)], SCHEMA), items, min_words=0, share=(1, 1)).collect()
    assert sorted((r.n_features, r["rank"]) for r in rows) == [(0, 1), (2, 2)] or sorted((r.n_features, r["rank"]) for r in rows) == [(0, 2), (2, 1)]


def test_offsets_are_those_of_the_whole_text():
    texts = ["Ein Wörtchen, naïve\tund\n\n日本 x", "", "A--b 'c'd"]
    body = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    owner, starts, ends, string, strings = resampling.offset_words(body, offsets)
    for i, text in enumerate(texts):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        want = [(w, *at) for w, at in resampling.splitter().pre_tokenize_str(low)]
        assert [(strings[k].decode(), a, b) for o, a, b, k in zip(owner, starts, ends, string) if o == i] == want
