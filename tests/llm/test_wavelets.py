"""Wavelet matrices of token ids: round trips, rank and select, and the tokens of whole texts."""

import os
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bedtide.llm import queries, wavelets
from bedtide.session import scratch_path

SCHEMA = "doc_id bigint, text string, `DOC_ID` string, start int"


def whole(text):
    return wavelets.tokenizer().encode(text or "", add_special_tokens=False).ids + [wavelets.END_ID]


def plain(rows):
    place, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = whole(text)
        out.append((doc_id, place, len(ids), crc32(np.array(ids, "<u4").tobytes())))
        place += len(ids)
    return out


def digest(frame):
    return sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in frame.collect()), key=lambda r: r[1])


TEXTS = ["Don't stop, it's 3:45pm...", " leading", "trailing \n", "a\n\nb\n c\n", "naïve café — 日本語  x  y　z", "'tis 'll've 'S", "<|endoftext|> not special<|endoftext|>", "x" * 5000, " " * 4000 + "a",
         "tab\there\r\nthere", "é. À! ß' ü\"", "\x00\x01 a\x1fb\x85c", "emoji 😀😃 👩‍👩‍👧", "(a) [b] {c}: d; e, f. g! h? i-j_k", "12,345.67 1st 2nd", "", None]


def test_pieces_give_the_tokens_of_the_whole_text():
    body = np.frombuffer("".join(t or "" for t in TEXTS).encode(), np.uint8)
    offsets = np.cumsum([0, *(len((t or "").encode()) for t in TEXTS)])
    ids, sizes = wavelets.with_end(*wavelets.token_ids(body, offsets), wavelets.END_ID)
    bounds = np.cumsum([0, *sizes])
    for i, t in enumerate(TEXTS):
        assert ids[bounds[i]:bounds[i + 1]].tolist() == whole(t)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(list("aZ9 '.,s\n\t!é\u3000日\u0301\x85") + ["'s", " b", "  "])).map("".join) | st.text(max_size=40))
def test_pieces_of_any_text(text):
    body = np.frombuffer(text.encode("utf-8", "ignore"), np.uint8)
    ids, _ = wavelets.token_ids(body, np.array([0, len(body)]))
    assert ids.tolist() == whole(body.tobytes().decode())[:-1]


@pytest.mark.parametrize("n,bits", [(0, 16), (1, 16), (511, 3), (512, 1), (513, 16), (5000, 16), (3000, 17)])
def test_matrix(n, bits):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n) - 1, (1 << bits) - 1).astype(np.uint32)
    planes, counts, zeros = wavelets.build(ids, bits)
    matrix = wavelets.WaveletMatrix(n, planes, counts, zeros)
    assert np.array_equal(matrix.all(), ids)
    at = rng.integers(0, max(n, 1), 200) if n else np.zeros(0, int)
    assert np.array_equal(matrix.access(at), ids[at])
    for token in [*set(ids[:20].tolist()), 0, (1 << bits) - 1, 1 << bits]:
        assert matrix.places(token).tolist() == np.flatnonzero(ids == token).tolist()
        low, high = np.sort(rng.integers(0, n + 1, (2, 50)), axis=0)
        assert matrix.count(token, low, high).tolist() == [int((ids[a:b] == token).sum()) for a, b in zip(low, high)]


def test_query(spark, small_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()]
    assert digest(queries.op13_wavelets(spark, small_dir)) == plain(rows)


def test_files_and_lookups(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 6)] + [(None, "no number"), (5, "again"), (5, "again")]
    rng = np.random.default_rng(0)
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in (rows[i] for i in rng.permutation(len(rows)))], SCHEMA)
    path = scratch_path(spark, "test-shards")
    wavelets.write_shards(frame, path, shard_tokens=500)
    files = [f for f in os.listdir(path) if f.endswith(".parquet")]
    shards = wavelets.read_shards(spark, path)
    assert shards.count() == len(files) > 5
    got = digest(wavelets.document_table(shards))
    want = plain(rows)
    assert [r for r in got if r[0] != 5] == [r for r in want if r[0] != 5] and sorted(r[2:] for r in got if r[0] == 5) == sorted(r[2:] for r in want if r[0] == 5)
    begin = {r[1]: r for r in got}
    stream = np.zeros(sum(r[2] for r in got), int)
    texts = {}
    for d, t in rows:
        ids = whole(t)
        texts.setdefault((d, crc32(np.array(ids, "<u4").tobytes())), ids)
    for at, r in begin.items():
        stream[at:at + r[2]] = texts[r[0], r[3]]
    token = whole("a")[0]
    places = sorted((r.place, r.doc_id, r.position) for r in wavelets.occurrences(shards, token).collect())
    assert [p[0] for p in places] == np.flatnonzero(stream == token).tolist() and places
    assert all((d, p - q) in {(r[0], r[1]) for r in got} for p, d, q in places)
    assert sum(r.n for r in wavelets.token_frequency(shards, token).collect()) == len(places)
    some = [0, 17, len(stream) - 1, len(stream)]
    assert sorted((r.place, r.token) for r in wavelets.tokens_at(shards, some).collect()) == [(p, stream[p]) for p in some[:3]]


def test_empty_table_and_long_runs(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert wavelets.token_files(empty).count() == 0
    rows = [(1, " " * 1_000_000), (2, "a" * 300_000), (3, "word, " * 100_000)]
    assert digest(wavelets.token_files(spark.createDataFrame([(d, t, None, None) for d, t in rows], SCHEMA))) == plain(rows)
