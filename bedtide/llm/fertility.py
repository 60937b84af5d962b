"""Quality rules: what tokenisers make of a text, beside plain counts on its words and lines.

Whole texts are tokenised with two public vocabularies: a byte-level BPE gives characters per token and the
entropy of the tokens, a piece BPE with byte fallback gives the share of bytes that it has no piece for. Each
script has a band for every figure; a text outside any band of its main script is rejected.
"""

from __future__ import annotations

import base64
import importlib.util
import os
import re
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from bedtide.llm import text as X
from bedtide.llm.frames import documents_of

MIN_WORDS, REPEAT_PERCENT = 50, 50
BPE_FILE, PIECE_FILE = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# White space of Unicode (fixed values). The split looks ahead from every place of such a run, on a stack that ends near a million.
LONG_BLANKS = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{100000,}")

SCRIPTS = ("latin", "cyrillic", "han", "other")
# For each script: characters per token, share of byte-fallback tokens, entropy of tokens in bits (low, high).
# English and other Latin prose has two to five characters a token and five to ten bits. Below one and a
# half characters the text is mostly marks and digits; a thousandth of bytes is common, a fifth is binary
# junk; under three bits the same few tokens return for ever.
BANDS = {
    "latin": ((1.5, 12.0), (0.0, 0.2), (3.0, 16.0)),
    "cyrillic": ((0.5, 12.0), (0.0, 0.3), (3.0, 16.0)),
    "han": ((0.3, 8.0), (0.0, 0.6), (3.0, 16.0)),
    "other": ((0.3, 12.0), (0.0, 0.9), (3.0, 16.0)),
}
SYMBOLS = X.byte_class(lambda b: b in b"#*$%&|<>")


def vocabulary_folder() -> str:
    """Where the public vocabulary files are installed on this machine."""
    spec = importlib.util.find_spec("public_tokenizers")
    return os.path.dirname(spec.origin) if spec else "/opt/tokenizers"


@cache
def encoders(folder: str):
    import sentencepiece
    import tiktoken

    with open(f"{folder}/{BPE_FILE}", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    pieces = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{PIECE_FILE}")
    is_byte = np.array([pieces.is_byte(i) for i in range(pieces.vocab_size())])
    bpe, unsplit = (tiktoken.Encoding("bytes", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (PATTERN, "(?s:.+)"))
    return (bpe, unsplit), pieces, is_byte


def bpe_tokens(bpe, unsplit, text: str, long_blanks: re.Pattern = LONG_BLANKS) -> list[int]:
    """Tokens of ``text``. Of a run of white space before a word the split takes all but the last character as one piece; that piece
    is cut out of long runs and goes to ``unsplit``, the same vocabulary without a split."""
    tokens, done = [], 0
    for run in long_blanks.finditer(text):
        end = run.end() - (run.end() < len(text))
        tokens += bpe.encode_ordinary(text[done:run.start()]) + unsplit.encode_ordinary(text[run.start():end])
        done = end
    return tokens + bpe.encode_ordinary(text[done:])


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` in each text."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeat_words(words: np.ndarray, firsts: np.ndarray, k: int = 3) -> np.ndarray:
    """For each text the words that lie in windows of ``k`` found twice or more in it."""
    text_of = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    grams = X.gram_hashes(words, k)
    inside = text_of[:len(grams)] == text_of[k - 1:]
    at = np.flatnonzero(inside)
    keys = X.mix(grams[at] + text_of[at].astype(np.uint64) * np.uint64(X.BASE))
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    covered = np.zeros(len(words), bool)
    if len(twice):
        found = twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys
        for i in range(k):
            covered[at[found] + i] = True
    return _per_text(covered, firsts)


def duplicate_lines(body: np.ndarray, offsets: np.ndarray, word_starts: np.ndarray) -> np.ndarray:
    """For each text the lines with a word that equal an earlier line of it."""
    breaks = np.flatnonzero(body == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    text_of = np.searchsorted(offsets[1:], starts, "right")
    # A break at the very end of a text starts an empty line that the next text's first line must not replace.
    real = text_of < len(offsets) - 1
    starts, text_of = starts[real], text_of[real]
    next_break = np.searchsorted(breaks, starts)
    ends = np.concatenate([breaks, [len(body)]])[next_break]
    ends = np.minimum(ends, offsets[text_of + 1])
    filled = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    starts, ends, text_of = starts[filled], ends[filled], text_of[filled]
    order = np.lexsort((X.span_hashes(body, starts, ends), text_of))
    hashes, owner = X.span_hashes(body, starts, ends)[order], text_of[order]
    again = np.zeros(len(order), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    return np.bincount(owner[again], minlength=len(offsets) - 1)


def main_script(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index in SCRIPTS of the script with most letters, judged by the lead bytes of UTF-8."""
    lead = [
        X.byte_class(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or 0xC3 <= b <= 0xC9)[body],
        X.byte_class(lambda b: 0xD0 <= b <= 0xD3)[body],
        X.byte_class(lambda b: 0xE3 <= b <= 0xE9)[body],
        X.byte_class(lambda b: 0xCA <= b <= 0xCF or 0xD4 <= b <= 0xE2 or 0xEA <= b)[body],
    ]
    return np.argmax(np.stack([_per_text(x, offsets) for x in lead]), axis=0)


def token_figures(texts: list[str], n_chars: np.ndarray, folder: str) -> dict[str, np.ndarray]:
    bpe, pieces, is_byte = encoders(folder)
    tokens = [np.array(bpe_tokens(*bpe, t), np.int64) for t in texts]
    sizes = np.array([len(t) for t in tokens], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    keys, counts = np.unique(owner << 32 | np.concatenate([*tokens, np.zeros(0, np.int64)]), return_counts=True)
    text_of = keys >> 32
    share = counts / np.maximum(sizes, 1)[text_of]
    entropy = np.bincount(text_of, -share * np.log2(share), minlength=len(texts))
    fallback = np.zeros(len(texts))
    for i, ids in enumerate(pieces.encode(texts, num_threads=1)):
        if ids:
            fallback[i] = is_byte[ids].mean()
    return {"n_tokens": sizes, "chars_per_token": n_chars / np.maximum(sizes, 1), "byte_fallback": fallback, "entropy": np.abs(entropy).astype(float)}


SCHEMA = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, "
          "kept boolean, script string, n_tokens bigint, chars_per_token double, byte_fallback double, entropy double")


def quality(documents: DataFrame, bands: dict = BANDS, folder: str | None = None) -> DataFrame:
    """Counts, token figures and verdict (``kept``) for each row of ``documents``.

    Base rule: fewer than 50 words, or more than half of them in repeated windows of three, fails. A text
    that passes is kept if its figures lie in the bands of its script. Null and empty texts have no words and
    fail; repeated rows each get their row; a null doc_id stays null. ``folder`` holds the vocabulary files
    and must exist on every executor; by default it is where the package is installed there.
    """
    rows = documents_of(documents)
    limits = np.array([bands[s] for s in SCRIPTS])

    def run(batches):
        place = folder or vocabulary_folder()
        for batch in batches:
            for part, body, offsets in X.chunks(batch):
                yield _judge(part, body, offsets, limits, place)

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")


def _judge(part, body, offsets, limits, folder):
    starts, ends, firsts = X.word_bounds(body, offsets, X.UNSPACED)
    n_words = np.diff(firsts)
    points = (body & 0xC0) != 0x80
    repeats = repeat_words(X.span_hashes(body, starts, ends), firsts)
    failed = (n_words < MIN_WORDS) | (100 * repeats > REPEAT_PERCENT * n_words)
    figures = token_figures(pc.fill_null(part.column(1), "").to_pylist(), _per_text(points, offsets), folder)
    script = main_script(body, offsets)
    measured = np.stack([figures["chars_per_token"], figures["byte_fallback"], figures["entropy"]], axis=1)
    inside = ((limits[script, :, 0] <= measured) & (measured <= limits[script, :, 1])).all(axis=1)
    columns = {
        "doc_id": part.column(0), "n_words": n_words, "word_chars": _per_text(points & X.UNSPACED[body], offsets),
        "n_symbols": _per_text(SYMBOLS[body], offsets), "n_dup_lines": duplicate_lines(body, offsets, starts),
        "n_repeat_words": repeats, "base_failed": failed, "kept": ~failed & inside,
        "script": [SCRIPTS[i] for i in script], **figures,
    }
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))
