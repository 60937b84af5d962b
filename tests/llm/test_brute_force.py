"""Operators that SQL can't express against plain versions of their contracts."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from bedtide.llm import licenses, queries, simhash, suffixes, trie_tokens


@pytest.fixture(scope="module")
def documents(spark, small_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def plain_words(text):
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(upper, upper.lower())))


def test_license_base(spark, small_dir, documents):
    for r in queries.op1_license_scan(spark, small_dir).collect():
        there = plain_words(documents[r.doc_id])
        places, labels = [], set()
        for phrase, label in licenses.BASE.items():
            run = phrase.split()
            at = [i for i in range(len(there)) if there[i:i + len(run)] == run]
            places += at
            labels |= {label} if at else set()
        ends = (min(places), max(places)) if places else (None, None)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(there), len(places), *ends, ",".join(sorted(labels)))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and (r.score == 1 if places else 0 <= r.score <= 1)


def test_license_edits(spark):
    texts = ["Permission is herby granted, free of charge, to any persn obtaining a copy", "Licensed under the Apache Licence, Version 2.0",
             "Licensed under CC BY-NC 4.0.", "permission denied to all", "Released under the MIT License, mit license"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = {r.doc_id: r for r in licenses.license_digest(licenses.license_spans(frame)).collect()}
    assert [found[i].labels for i in range(5)] == ["mit", "apache", "cc-by-nc", "", "mit"]
    assert 0.9 < found[0].score < 1 and found[2].score == 1 and found[3].score == 0
    assert (found[4].n_base, found[4].first_word, found[4].last_word) == (2, 3, 5)


def removed(documents, length):
    first = {}
    for d in sorted(documents):
        body = documents[d]
        for i in range(len(body) - length + 1):
            first.setdefault(body[i:i + length], d)
    for d, body in documents.items():
        gone = bytearray(len(body))
        for i in range(len(body) - length + 1):
            if first[body[i:i + length]] < d:
                gone[i:i + length] = b"\x01" * length
        kept = bytes(x for x, g in zip(body, gone) if not g)
        yield d, len(body), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("settings", [{}, {"block_bytes": 20000, "range_samples": 20000}, {"block_bytes": 20000, "hot_blocks": 3}])
def test_suffix_dedup(spark, small_dir, documents, settings):
    frame = spark.read.parquet(f"{small_dir}/documents.parquet").repartition(3)
    got = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(frame, with_text=False, **settings).collect()}
    assert got == set(removed({d: t.encode() for d, t in documents.items()}, 50))


def test_suffix_dedup_on_few_letters(spark):
    dice = np.random.default_rng(3)
    documents = {i: bytes(dice.choice(list(b"ab"), int(dice.integers(0, 400))).tolist()) for i in range(30)}
    documents |= {100 + i: documents[i][30:200] + b"ab" * int(dice.integers(0, 60)) + documents[i][:90] for i in range(30)}
    frame = spark.createDataFrame([(i, b.decode()) for i, b in documents.items()], "doc_id bigint, text string")
    for length in (40, 50, 61):
        got = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(frame, length, with_text=False).collect()}
        assert got == set(removed(documents, length))


def test_suffix_dedup_files(spark, monkeypatch):
    """Files grow with blocks and with ranges, not with their product."""
    dice = np.random.default_rng(5)
    documents = {i: bytes(dice.choice(list(b"ab"), int(dice.integers(200, 900))).tolist()) for i in range(60)}
    documents |= {100 + i: documents[i][20:150] + b"ab" * int(dice.integers(0, 60)) + documents[i + 7][90:300] for i in range(50)}
    frame = spark.createDataFrame([(i, b.decode()) for i, b in documents.items()], "doc_id bigint, text string").repartition(5)
    n_bytes, block_bytes, range_samples = sum(map(len, documents.values())), 1500, 200
    ranges = -(-n_bytes * len(suffixes.COVER) // suffixes.PERIOD // range_samples)
    files, put = [], suffixes._Tables.put
    monkeypatch.setattr(suffixes._Tables, "put", lambda *args, **named: [table := put(*args, **named), files.append(len(table.inputFiles()))][0])
    found = suffixes.remove_repeats(frame, with_text=False, hot_blocks=3, block_bytes=block_bytes, range_samples=range_samples).collect()
    assert {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == set(removed(documents, 50))
    assert ranges > 40 and max(files) <= max(2 * n_bytes // block_bytes, 2 * ranges)


def test_difference_cover():
    for i in range(suffixes.PERIOD):
        for j in range(suffixes.PERIOD):
            assert any((i + k) % suffixes.PERIOD in suffixes.COVER and (j + k) % suffixes.PERIOD in suffixes.COVER for k in range(suffixes.PERIOD))


def plain_fingerprint(text):
    there = text.encode().lower().split()
    if not there:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(there[i:i + 3]), 42) for i in range(max(1, len(there) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, small_dir, documents):
    prints = {d: plain_fingerprint(t) for d, t in documents.items()}
    label = {d: d for d in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if label[b] < label[a] and (prints[a] ^ prints[b]).bit_count() <= 2:
                    label[a], changed = label[b], True
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op5_simhash(spark, small_dir).collect()}
    assert got == {d: (f"{prints[d]:016x}", label[d]) for d in prints}


def test_covering_masks_miss_no_pair():
    masks = simhash.covering_masks()
    for i in range(64):
        for j in range(64):
            assert any(not m >> i & 1 and not m >> j & 1 for m in masks)


def test_quality_counts(spark, small_dir, documents):
    for r in queries.op7_fertility(spark, small_dir).collect():
        text, there = documents[r.doc_id], words(documents[r.doc_id])
        grams = Counter(zip(there, there[1:], there[2:]))
        repeated = {i + j for i in range(len(there) - 2) if grams[tuple(there[i:i + 3])] > 1 for j in range(3)}
        seen, lines = set(), 0
        for line in text.split("\n"):
            if words(line):
                lines += line in seen
                seen.add(line)
        failed = len(there) < 50 or 100 * len(repeated) > 50 * len(there)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (
            len(there), sum(map(len, there)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(repeated), failed)
        assert not (failed and r.kept)


def test_rejection_by_tokens(spark):
    junk = " ".join(chr(0x1F300 + i % 700) for i in range(400))
    prose = " ".join("a plain sentence about the weather in the northern hills of some old country near water".split()[i % 16] + str(i % 7) for i in range(100))
    frame = spark.createDataFrame([(1, junk), (2, prose)], "doc_id int, text string")
    from bedtide.llm.fertility import BANDS, quality

    assert {r.doc_id: r.kept for r in quality(frame).collect()}[2]
    strict = BANDS | {"other": ((0.3, 12.0), (0.0, 0.5), (3.0, 16.0))}
    kept = {r.doc_id: (r.kept, r.byte_fallback) for r in quality(frame, strict).collect()}
    assert kept[2][0] and not kept[1][0] and kept[1][1] > 0.5


def test_token_counts(spark, small_dir, documents):
    scores = trie_tokens.vocabulary(trie_tokens.vocabulary_folder())
    unknown, memo = min(scores.values()) - trie_tokens.UNKNOWN_LOSS, {}

    def best(word):
        if word not in memo:
            text = trie_tokens.MARK + word
            top, count = [0.0] + [float("-inf")] * len(text), [0] * (len(text) + 1)
            for end in range(1, len(text) + 1):
                for size in range(1, min(end, 48) + 1):
                    piece = text[end - size:end].encode()
                    gain, cost = (scores[piece], 1) if piece in scores else (unknown * len(piece), len(piece)) if size == 1 else (float("-inf"), 0)
                    if gain > float("-inf") and top[end - size] + gain >= top[end]:
                        top[end], count[end] = top[end - size] + gain, count[end - size] + cost
            memo[word] = count[-1], top[-1]
        return memo[word]

    for r in queries.op9_token_counts(spark, small_dir).collect():
        there = [best(w) for w in words(documents[r.doc_id])]
        assert (r.n_pretokens, r.n_tokens) == (len(there), sum(n for n, _ in there))
        assert abs(r.log_prob - sum(s for _, s in there)) < 1e-3


def test_components(spark):
    from bedtide.llm.components import components

    dice = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in dice.integers(0, 300, (260, 2))] + [(1000 + i, 1001 + i) for i in range(80)] + [(7, 7)]
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    label = {}
    for start in sorted(near):
        if start not in label:
            todo = [start]
            while todo:
                node = todo.pop()
                if node not in label:
                    label[node] = start
                    todo += near[node]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == label
