"""Spelling variants: near words by blocked Gram matrices, then the word each one stands for.

Words are runs of Latin letters. One edit moves the letter counts of a word by a squared distance of 1 (a letter more
or less) or of 0 or 2 (a letter replaced), so near words lie in the same or in adjacent length blocks and their
distance is at most two. Distances of a pair of blocks come from one matrix product, |a|^2 + |b|^2 - 2ab; the pairs
that stay are compared letter by letter.

A length block is cut further by how many of its letters fall in each of five classes: one edit moves one letter out of
a class or into one, so a cell meets itself, 10 cells of its length and five of the next (pairs taken once). Cells of
more than ``TILE_WORDS`` words are dealt out in tiles, and a unit of work is a pair of tiles, whatever the vocabulary.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bedtide.llm.frames import pick
from bedtide.session import materialise

RUN = re.compile("[a-zÀ-ÿ]+")  # in texts whose A-Z are lower case
LETTERS = [*range(0x61, 0x7B), *range(0xC0, 0x100)]  # all of Latin-1, so a letter is a byte
CLASSES = 5
MIN_LETTERS, MIN_COUNT, LOSS = 5, 3, 97
TILE_WORDS, TILE_BYTES = 4096, 4 << 20
HELD_WORDS = 400_000  # distinct words a task holds before it passes them on
STRIP = 1 << 20  # entries of a Gram matrix at a time
_COLUMN = np.zeros(256, np.int64)
_COLUMN[LETTERS] = np.arange(len(LETTERS))


def _runs(text: str):
    text = text.encode().lower().decode()  # of bytes, only A-Z change
    return Counter(RUN.findall(text) if len(text) < 1 << 22 else (m.group() for m in RUN.finditer(text)))


def word_counts(documents: DataFrame, loss: int = LOSS, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words of at least ``min_letters`` letters that occur ``min_count`` times or more.

    With h the crc32 of "doc_id:run", a run whose h is a multiple of ``loss`` loses its letter h modulo length.
    """
    rows = pick(documents, doc_id="doc_id", text="text").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")

    def table(found):
        return pa.RecordBatch.from_pydict({"word": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})

    def run(batches):
        found = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                seed = crc32(f"{doc_id.as_py()}:".encode())
                for word, n in _runs(text.as_py() or "").items():
                    if len(word) < min_letters:
                        continue
                    h = crc32(word.encode(), seed)
                    if h % loss == 0:
                        word = word[:h % len(word)] + word[h % len(word) + 1:]
                    if len(word) >= min_letters:
                        found[word] += n
                if len(found) > HELD_WORDS:
                    yield table(found)
                    found = Counter()
        yield table(found)

    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _class_counts(word) -> list:
    """Of each class of letters (code point modulo ``CLASSES``), how many the word has; their sum is its length."""
    others = ("".join(chr(c) for c in LETTERS if c % CLASSES != k) for k in range(CLASSES))
    return [F.length(F.translate(word, text, "")) for text in others]


def _neighbours(counts: list[int]) -> list[str]:
    """The cell itself, those of its length one replacement away (each pair from one side) and those a letter longer."""
    cells = [list(counts)]
    for i in range(CLASSES):
        longer = list(counts)
        longer[i] += 1
        cells.append(longer)
        for j in range(i + 1, CLASSES):
            if counts[j]:
                moved = list(longer)
                moved[j] -= 1
                cells.append(moved)
    return [",".join(map(str, c)) for c in cells]


def tiles(words: DataFrame) -> DataFrame:
    """(cell, n_tiles, tile, near, size, body, counts): the words of a tile in order, as bytes of Latin-1 end to end."""
    placed = words.withColumn("cell", F.concat_ws(",", *_class_counts(F.col("word"))))
    sizes = placed.groupBy("cell").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / TILE_WORDS), F.ceil(F.sum(F.length("word")) / TILE_BYTES)).alias("n_tiles"))
    dealt = placed.join(sizes, "cell").withColumn("tile", F.pmod(F.xxhash64("word"), F.col("n_tiles")))
    lists = dealt.groupBy("cell", "n_tiles", "tile").agg(F.sort_array(F.collect_list(F.struct("word", "n"))).alias("w"))
    flat = lists.select("cell", "n_tiles", "tile", F.col("w.word").alias("words"), F.col("w.n").alias("counts"))

    def run(batches):
        for batch in batches:
            cells, words = batch.column(0).to_pylist(), batch.column(3).to_pylist()
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), batch.column(2), pa.array([_neighbours([int(x) for x in c.split(",")]) for c in cells], pa.list_(pa.string())),
                pa.array([len(w[0]) for w in words], pa.int32()), pa.array(["".join(w).encode("latin-1") for w in words], pa.binary()), batch.column(4),
            ], names=["cell", "n_tiles", "tile", "near", "size", "body", "counts"])

    return flat.mapInArrow(run, "cell string, n_tiles bigint, tile bigint, near array<string>, size int, body binary, counts array<bigint>")


def letter_counts(words: np.ndarray) -> np.ndarray:
    """(word, letter) of a (word, position) table of bytes; doubles where products could leave the range of floats."""
    place = np.arange(len(words))[:, None] * len(LETTERS) + _COLUMN[words]
    counts = np.bincount(place.ravel(), minlength=len(words) * len(LETTERS)).reshape(len(words), len(LETTERS))
    return counts.astype(np.float32 if words.shape[1] < 2048 else np.float64)


def close_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two (word, letter) tables whose squared distance is at most two."""
    squares, found = np.einsum("ij,ij->i", b, b), []
    step = max(1, STRIP // max(1, len(b)))
    for first in range(0, len(a), step):
        some = a[first:first + step]
        gram = np.einsum("ij,ij->i", some, some)[:, None] + squares - 2 * (some @ b.T)
        i, j = np.nonzero(gram <= 2)
        found.append((i + first, j))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of ``a`` (pair, length) are one edit from those of ``b`` (as long, or a letter longer)."""
    size = a.shape[1]
    if b.shape[1] == size:
        return (a != b).sum(axis=1) == 1
    ahead = np.logical_and.accumulate(a == b[:, :size], axis=1).sum(axis=1)
    behind = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return ahead + behind >= size


def near_pairs(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of words of two tiles that are one edit apart, those of one tile once."""
    i, j = close_pairs(letter_counts(a), letter_counts(b))
    if same:
        i, j = i[i < j], j[i < j]
    keep, step = np.zeros(len(i), bool), max(1, 4 * STRIP // b.shape[1])
    for first in range(0, len(i), step):
        some = slice(first, first + step)
        keep[some] = one_edit(a[i[some]], b[j[some]])
    return i[keep], j[keep]


def _best(own: np.ndarray, other: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word in ``own``: how many near words it has, and the one with the largest count (the first of equals)."""
    order = np.lexsort((other, -counts[other], own))
    words, first, n = np.unique(own[order], return_index=True, return_counts=True)
    return words, n, other[order][first]


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) for the words of ``words`` (word, n) that have a near word."""
    blocks = materialise(tiles(words))
    plain = blocks.select("cell", "n_tiles").distinct()
    ahead = blocks.select(F.col("cell").alias("cell_a"), F.col("tile").alias("tile_a"), F.explode("near").alias("cell"))
    units = ahead.join(plain, "cell").withColumn("tile", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_tiles") - 1))).drop("n_tiles")
    units = units.where((F.col("cell_a") != F.col("cell")) | (F.col("tile_a") <= F.col("tile")))
    body = ("size", "body", "counts")
    left = blocks.select(F.col("cell").alias("cell_a"), F.col("tile").alias("tile_a"), *(F.col(c).alias(f"{c}_a") for c in body))
    right = blocks.select("cell", "tile", *(F.col(c).alias(f"{c}_b") for c in body))
    full = units.join(left, ["cell_a", "tile_a"]).join(right, ["cell", "tile"])
    same = (F.col("cell_a") == F.col("cell")) & (F.col("tile_a") == F.col("tile"))

    def run(batches):
        for batch in batches:
            rows = {"word": [], "n_near": [], "best_n": [], "best": []}
            for r in range(batch.num_rows):
                one, *sides = (batch.column(c)[r] for c in range(7))
                (a, na), (b, nb) = (
                    (np.frombuffer(sides[k + 1].as_buffer(), np.uint8).reshape(-1, sides[k].as_py()), sides[k + 2].values.to_numpy()) for k in (0, 3))
                i, j = near_pairs(a, b, one.as_py())
                if one.as_py():
                    found = [(a, *_best(np.concatenate([i, j]), np.concatenate([j, i]), na), a, na)] if len(i) else []
                else:
                    found = [(a, *_best(i, j, nb), b, nb), (b, *_best(j, i, na), a, na)] if len(i) else []
                for own, at, n, best, other, counts in found:
                    rows["word"] += [own[k].tobytes().decode("latin-1") for k in at]
                    rows["best"] += [other[k].tobytes().decode("latin-1") for k in best]
                    rows["n_near"] += n.tolist()
                    rows["best_n"] += counts[best].tolist()
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())]))

    found = full.select(same.alias("same"), *(f"{c}_{s}" for s in "ab" for c in body)).mapInArrow(run, "word string, n_near bigint, best_n bigint, best string")
    top = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best"))).alias("top")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), top).select("word", "n_near", (-F.col("top.less")).alias("best_n"), F.col("top.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last word that following forms leads to.

    Each round joins the links to themselves and so doubles their reach. A form occurs at least twice as often as its
    word, so that no chain has more than 63 links and six or seven rounds do.
    """
    links = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = materialise(links.select("word", "root").join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if links.where("moved").isEmpty():
            return links.select("word", "root")


def spelling_variants(documents: DataFrame, loss: int = LOSS, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``documents`` (doc_id, text).

    ``form`` is the near word that occurs most often (the first in code-point order of equals) if it does at least
    twice as often, else null; ``root`` is where forms lead in the end, the word itself if it has none. Null and empty texts
    have no words; a null doc_id counts as empty text in the hash; repeated rows count each; an empty table gives no rows;
    other columns are not read.
    """
    words = materialise(word_counts(documents, loss, min_letters, min_count))
    near = words.join(near_words(words), "word", "left")
    has = F.col("best_n") >= 2 * F.col("n")
    table = materialise(near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")))
    led = roots(table.where("form is not null"))
    return table.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
