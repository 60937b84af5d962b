"""Long words: the path for single ones equals the trie's, and a word of a megabyte takes seconds."""

import random
import time

import numpy as np

from bedtide.llm import trie_tokens
from bedtide.llm.fertility import vocabulary_folder


def test_long_words_equal_the_trie():
    table = trie_tokens.pieces(vocabulary_folder())
    rng = random.Random(4)
    words = ["".join(rng.choice(["a", "the", "ing", "Z", "9", "é", "日", "😀", "\x01", "=="]) for _ in range(rng.randint(1, 700))) for _ in range(25)]
    words = sorted({(trie_tokens.MARK + w).encode() for w in words})
    body = np.frombuffer(b"".join(words), np.uint8)
    stops = np.cumsum([len(w) for w in words])
    tokens, scores = trie_tokens.segment(body, stops - [len(w) for w in words], stops, table)
    for word, n, score in zip(words, tokens.tolist(), scores.tolist()):
        got = trie_tokens.segment_long(np.frombuffer(word, np.uint8), table)
        assert got[0] == n and abs(got[1] - score) < 1e-6 * abs(score)


def test_a_megabyte_in_seconds(spark):
    rng = random.Random(5)
    blob = "".join(rng.choice("ABCDEFGHijklmnop0123456789+/") for _ in range(1_000_000))
    start = time.perf_counter()
    row = trie_tokens.token_counts(spark.createDataFrame([(1, f"one {blob} two")], "doc_id int, text string")).first()
    assert row.n_pretokens == 3 and row.n_tokens > 100_000 and time.perf_counter() - start < 90
