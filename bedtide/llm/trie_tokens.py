"""Token counts with a unigram model, shared along a trie of distinct pre-tokens.

A text is cut at white space; every word with a word mark before it is a pre-token. The distinct pre-tokens of some
megabytes of text are sorted, which is the order of a trie: what a word shares with the one before is a path
it does not open again. Level by level, each new trie node gets the best score of its prefix, from the scores
of the nodes above and the pieces that end there, once for all words that share it; a word's last node holds
its count, and counts go to the texts by the words' places. Words of more than 512 bytes are no words that others begin
like; each is segmented for itself.

Pieces come from a public vocabulary. Its order is one of frequency, so a piece's probability follows Zipf's
law in its rank. A character that the vocabulary lacks costs one token for each of its bytes.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from bedtide.llm import text as X
from bedtide.llm.fertility import PIECE_FILE, vocabulary_folder
from bedtide.llm.frames import documents_of

MARK = "▁"
UNKNOWN_LOSS = 10.0  # a byte of an unknown character is that much below the rarest piece
TRIE_BYTES = 8 << 20
LONG_WORD, LONG_PLACES = 512, 1 << 15  # words of more bytes share no trie; places of theirs looked up at once


@cache
def vocabulary(folder: str) -> dict[bytes, float]:
    """Pieces as bytes with their log-probabilities."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{PIECE_FILE}")
    names = [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    whole = np.log(np.sum(1.0 / np.arange(1, len(names) + 1)))
    return {name.encode(): float(-np.log(rank) - whole) for rank, name in enumerate(names, 1)}


class Pieces:
    """The vocabulary as an open hash table that numpy can search."""

    def __init__(self, scores: dict[bytes, float]):
        body = np.frombuffer(b"".join(scores), np.uint8)
        ends = np.cumsum([len(p) for p in scores])
        keys = X.span_hashes(body, ends - [len(p) for p in scores], ends)
        self.longest = max(map(len, scores))
        self.unknown = min(scores.values()) - UNKNOWN_LOSS
        self.mask = np.uint64((1 << (len(scores) * 4).bit_length()) - 1)
        self.keys = np.zeros(int(self.mask) + 1, np.uint64)
        self.scores = np.full(int(self.mask) + 1, -np.inf)
        for key, score in zip(keys, scores.values()):
            at = int(key & self.mask)
            while self.keys[at]:
                at = (at + 1) & int(self.mask)
            self.keys[at], self.scores[at] = key, score

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Scores of the pieces with these hashes, -inf where there is none."""
        at = (keys & self.mask).astype(np.int64)
        out = np.full(len(keys), -np.inf)
        left = np.arange(len(keys))
        while len(left):
            there = self.keys[at]
            hit = there == keys[left]
            out[left[hit]] = self.scores[at[hit]]
            go = ~hit & (there != 0)
            left, at = left[go], (at[go] + 1) & int(self.mask)
        return out


@cache
def pieces(folder: str) -> Pieces:
    return Pieces(vocabulary(folder))


def segment(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, vocabulary: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and score of the best segmentation of each of the sorted, distinct words body[start:end]."""
    n, lengths = len(starts), ends - starts
    tokens, scores = np.zeros(n, np.int64), np.zeros(n)
    if not n:
        return tokens, scores
    power, inverse = X._powers(len(body) + 1)
    total = np.zeros(len(body) + 1, np.uint64)
    np.cumsum((body.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
    shared = _shared_prefix(body, starts, lengths)
    first_of_character = np.append((body & 0xC0) != 0x80, True)
    keep = vocabulary.longest + 1
    best, count = np.full((keep, n), -np.inf), np.zeros((keep, n), np.int64)
    best[0], living = 0.0, np.arange(n)
    for depth in range(1, int(lengths.max()) + 1):
        living = living[lengths[living] >= depth]
        # A node is new where the word before leaves the path above it; the others share that word's node.
        new = shared[living] < depth
        opener = living[new]
        at = starts[opener] + depth
        ending = first_of_character[at] | (lengths[opener] == depth)
        node, at = opener[ending], at[ending]
        top, tally = np.full(len(node), -np.inf), np.zeros(len(node), np.int64)
        for size in range(1, min(depth, vocabulary.longest) + 1):
            above = (depth - size) % keep
            open_ = np.flatnonzero(best[above, node] > -np.inf)
            if not len(open_):
                continue
            low, high = at[open_] - size, at[open_]
            gain = vocabulary.find(X.mix((total[high] - total[low]) * inverse[low]))
            if size <= 4:  # one character: unknown ones go by their bytes
                single = first_of_character[low] & (np.add.reduce([first_of_character[low + i] for i in range(size)]) == 1)
                spelled = single & (gain == -np.inf)
                gain = np.where(spelled, vocabulary.unknown * size, gain)
                cost = np.where(spelled, size, 1)
            else:
                cost = 1
            score = best[above, node[open_]] + gain
            better = score >= top[open_]
            better &= gain > -np.inf
            chosen = open_[better]
            top[chosen] = score[better]
            tally[chosen] = count[above, node[chosen]] + (cost[better] if isinstance(cost, np.ndarray) else cost)
        level = depth % keep
        best[level, opener] = -np.inf
        best[level, node], count[level, node] = top, tally
        owner = opener[np.cumsum(new) - 1]
        best[level, living], count[level, living] = best[level, owner], count[level, owner]
        done = living[lengths[living] == depth]
        tokens[done], scores[done] = count[level, done], best[level, done]
    return tokens, scores


def segment_long(word: np.ndarray, vocabulary: Pieces) -> tuple[int, float]:
    """``segment`` of one word: all pieces that end in some ten thousand places are looked up at once, then the best way to each
    place is one sum and one maximum over the places before. Of equal scores the longest last piece counts, as there."""
    n, reach = len(word), vocabulary.longest
    power, inverse = X._powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((word.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
    opens = np.append((word & 0xC0) != 0x80, True)
    characters = np.concatenate([[0], np.cumsum(opens)])
    best, count = np.full(reach + n + 1, -np.inf), np.zeros(reach + n + 1, np.int64)
    best[reach] = 0.0
    for first in range(1, n + 1, LONG_PLACES):
        ends = np.arange(first, min(n + 1, first + LONG_PLACES))
        ends = ends[opens[ends]]
        gain, cost = np.full((len(ends), reach), -np.inf), np.ones((len(ends), reach), np.int64)
        for size in range(1, reach + 1):
            some = np.flatnonzero(ends >= size)
            some = some[opens[ends[some] - size]]
            low, high = ends[some] - size, ends[some]
            found = vocabulary.find(X.mix((total[high] - total[low]) * inverse[low]))
            if size <= 4:
                spelled = (characters[high] - characters[low] == 1) & (found == -np.inf)
                found = np.where(spelled, vocabulary.unknown * size, found)
                cost[some[spelled], reach - size] = size
            gain[some, reach - size] = found
        for i, end in enumerate(ends.tolist()):
            score = best[end:end + reach] + gain[i]
            at = int(score.argmax())
            best[reach + end], count[reach + end] = score[at], count[end + at] + cost[i, at]
    return int(count[-1]), float(best[-1])


def _shared_prefix(body: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Bytes that each word shares with the word before; -1 for the first."""
    shared = np.full(len(starts), -1)
    open_, depth = np.arange(1, len(starts)), 0
    while len(open_):
        fits = (lengths[open_] > depth) & (lengths[open_ - 1] > depth)
        at = open_[fits]
        equal = body[starts[at] + depth] == body[starts[at - 1] + depth]
        shared[open_[~fits]] = depth
        shared[at[~equal]] = depth
        open_, depth = at[equal], depth + 1
    return shared


def token_counts(documents: DataFrame, folder: str | None = None) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens, log_prob) for each row of ``documents``.

    Null and empty texts have none and log-probability 0. Repeated rows each get their row. ``folder`` holds the
    vocabulary and must exist on every executor.
    """
    rows = documents_of(documents)

    def run(batches):
        table = pieces(folder or vocabulary_folder())
        for batch in batches:
            for part, body, offsets in X.chunks(batch, "text", TRIE_BYTES):
                starts, ends, firsts = X.word_bounds(body, offsets, X.UNSPACED)
                _, at, kind = np.unique(X.span_hashes(body, starts, ends), return_index=True, return_inverse=True)
                raw = body.tobytes()
                words = [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]
                mark = MARK.encode()
                long = [i for i, w in enumerate(words) if len(w) > LONG_WORD]
                order = np.array(sorted((i for i, w in enumerate(words) if len(w) <= LONG_WORD), key=words.__getitem__), np.int64)
                joined = np.frombuffer(b"".join([mark + words[i] for i in order.tolist()]), np.uint8)
                sizes = ends[at][order] - starts[at][order] + len(mark)
                stops = np.cumsum(sizes)
                tokens, scores = np.zeros(len(words), np.int64), np.zeros(len(words))
                tokens[order], scores[order] = segment(joined, stops - sizes, stops, table)
                for i in long:
                    tokens[i], scores[i] = segment_long(np.frombuffer(mark + words[i], np.uint8), table)
                sums = [np.concatenate([[0], np.cumsum(x[kind])]) for x in (tokens, scores)]
                per_text = [s[firsts[1:]] - s[firsts[:-1]] for s in sums]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(firsts).astype(np.int64)), pa.array(per_text[0].astype(np.int64)), pa.array(per_text[1].astype(float))],
                    names=["doc_id", "n_pretokens", "n_tokens", "log_prob"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_pretokens bigint, n_tokens bigint, log_prob double")
