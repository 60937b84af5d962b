"""Toxicity with a counterfactually regularised linear classifier.

A text's features are counts of its words and of the words' beginnings, hashed. The classifier is a logistic
regression with one more term in its loss: for every labelled sentence that names a group, each identity term
is swapped for the others of its category, and the squared change of the score is penalised. What a group is
called then weighs nothing by itself, so neutral mentions are not flagged, while the rest of the sentence
keeps its weight.

Which features may count is decided by their frequencies in all labelled texts. The weights are fitted on a
bounded sample of these, in one task, and all rows are scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bedtide.llm import text as X
from bedtide.llm.crf import _packed, _unpacked, held_out, labelled_sample
from bedtide.llm.frames import pick
from bedtide.llm.suffixes import pack_sorted, unpack_sorted
from bedtide.session import materialise

BUCKETS = 1 << 20
TRAIN_TEXTS = 3000  # labelled texts of each class, about
BEGINNINGS = (4, 5)  # bytes of a longer word that count as a feature
FEATURES, MIN_TEXTS, MIN_Z = 2000, 2, 3.0
ROUNDS, RATE, DECAY, SWAP_WEIGHT = 500, 0.05, 1e-4, 1.0
# Identity terms by category (fixed values); a term is swapped for the others of its line.
IDENTITIES = (
    ("women", "men", "girls", "boys", "transgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "african", "latino", "arab"),
    ("gay", "lesbian", "straight", "bisexual", "queer"),
    ("immigrant", "refugee", "foreigner", "migrant"),
    ("immigrants", "refugees", "foreigners", "migrants"),
    ("blind", "deaf", "disabled", "autistic"),
)
LETTERS = X.byte_class(lambda b: 0x61 <= b <= 0x7A or b >= 0x80)


def _slices(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Index of the first text and texts of some megabytes at a time."""
    first, size = 0, 0
    for i, t in enumerate(texts, 1):
        size += len(t)
        if size >= X.CHUNK_BYTES or i == len(texts):
            yield first, texts[first:i]
            first, size = i, 0


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hashed feature) of every word and word beginning, some megabytes at a time."""
    text_of, keys = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for first, part in _slices(texts):
        at, found = _features(part)
        text_of.append((at + first).astype(np.int32))
        keys.append(found.astype(np.int32))
    return np.concatenate(text_of), np.concatenate(keys)


def _features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.lower().encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    body = np.frombuffer(b"".join(raw), np.uint8)
    starts, ends, firsts = X.word_bounds(body, offsets, LETTERS)
    owner = np.repeat(np.arange(len(texts)), np.diff(firsts))
    text_of, keys = [owner], [X.span_hashes(body, starts, ends)]
    for n in BEGINNINGS:
        long = ends - starts > n
        text_of.append(owner[long])
        keys.append(X.mix(X.span_hashes(body, starts[long], starts[long] + n) + np.uint64(n)))
    return np.concatenate(text_of), (np.concatenate(keys) & np.uint64(BUCKETS - 1)).astype(np.int64)


def swaps(text: str, identities: tuple = IDENTITIES) -> list[str]:
    """The text with all its identity terms of a category exchanged, once for each shift within the category."""
    found = []
    for line in identities:
        pattern = re.compile(r"\b(?:" + "|".join(map(re.escape, line)) + r")\b", re.IGNORECASE)
        if pattern.search(text):
            for shift in range(1, len(line)):
                found.append(pattern.sub(lambda m: line[(line.index(m.group().lower()) + shift) % len(line)], text))
    return found


class Sparse:
    """A matrix of ``shape`` by its entries; those of the same place are summed, and zeros left out."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], shape: tuple[int, int]):
        codes, values = [np.zeros(0, np.int64)], [np.zeros(0)]
        for rows, columns, entries in parts:
            code, at = np.unique(rows.astype(np.int64) * shape[1] + columns, return_inverse=True)
            total = np.bincount(at, entries, minlength=len(code))
            codes.append(code[total != 0])
            values.append(total[total != 0])
        code, self.values, self.shape = np.concatenate(codes), np.concatenate(values), shape
        self.rows, self.columns = (code // shape[1]).astype(np.int32), (code % shape[1]).astype(np.int32)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.values * w[self.columns], minlength=self.shape[0])

    def transposed_times(self, e: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, self.values * e[self.rows], minlength=self.shape[1])

    def deviations(self) -> np.ndarray:
        mean, square = (np.bincount(self.columns, v, minlength=self.shape[1]) / self.shape[0] for v in (self.values, self.values ** 2))
        return np.sqrt(np.maximum(square - mean ** 2, 0))


def _matrix(texts: list[str], column: np.ndarray, width: int) -> Sparse:
    """Counts of the features that have a column; no text may come twice in different parts."""
    def part(first, some):
        text_of, keys = _features(some)
        chosen = column[keys] >= 0
        return text_of[chosen] + first, column[keys[chosen]], np.ones(int(chosen.sum()))

    return Sparse([part(*s) for s in _slices(texts)], (len(texts), width))


def _changes(texts: list[str], identities: tuple, column: np.ndarray, width: int) -> Sparse:
    """What each swap changes in the counts of its text, a row for every swap that changes any."""
    parts, n = [], 0
    for _, some in _slices(texts):
        for t in some:
            others = swaps(t, identities)
            text_of, keys = _features([t, *others])
            here = column[keys] >= 0
            text_of, at = text_of[here], column[keys[here]]
            own = np.bincount(at[text_of == 0], minlength=width)
            kept = np.flatnonzero(own)
            rows = np.concatenate([text_of[text_of > 0] - 1, np.repeat(np.arange(len(others)), len(kept))])
            moved = Sparse([(rows, np.concatenate([at[text_of > 0], np.tile(kept, len(others))]),
                             np.concatenate([np.ones(int((text_of > 0).sum())), np.tile(-own[kept].astype(float), len(others))]))], (len(others), width))
            which, place = np.unique(moved.rows, return_inverse=True)
            parts.append((place + n, moved.columns, moved.values))
            n += len(which)
    return Sparse(parts, (n, width))


def class_counts(texts: list[str], labels: np.ndarray) -> np.ndarray:
    """(class, feature), the number of texts with the feature."""
    found = np.zeros((2, BUCKETS))
    for first, part in _slices(texts):
        text_of, keys = _features(part)
        pairs = np.unique(text_of.astype(np.int64) * BUCKETS + keys)
        found += np.bincount(labels[first + pairs // BUCKETS] * BUCKETS + pairs % BUCKETS, minlength=2 * BUCKETS).reshape(2, BUCKETS)
    return found


def screened(found: np.ndarray, sizes: tuple[int, int]) -> np.ndarray:
    """Features whose text frequencies differ between the classes, those that differ most first."""
    n0, n1 = sizes
    p = found.sum(axis=0) / (n1 + n0)
    z = np.abs(found[1] / n1 - found[0] / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
    z[found.sum(axis=0) < MIN_TEXTS] = 0
    order = np.argsort(-z, kind="stable")
    return order[:int((z >= MIN_Z).sum())].astype(np.int32)


def fit(texts: list[str], labels: np.ndarray, weights: np.ndarray, swap_weight: float = SWAP_WEIGHT, identities: tuple = IDENTITIES,
        ranked: np.ndarray | None = None, most: int = FEATURES) -> dict[str, np.ndarray]:
    """``weights`` of the rows restore the classes' shares. The first ``most`` features of ``ranked`` that the texts
    have take part, and identity terms always do. Unless given, features are ranked by the texts themselves."""
    share = float(np.average(labels, weights=weights)) if len(labels) else 0.0
    empty = {"at": np.zeros(0, np.int64), "weights": np.zeros(0), "bias": np.array(np.log((share + 1e-3) / (1 - share + 1e-3)))}
    if not 0 < share < 1:
        return empty
    found = class_counts(texts, labels)
    if ranked is None:
        ranked = screened(found, (int((labels == 0).sum()), int(labels.sum())))
    chosen = ranked[found.sum(axis=0)[ranked] > 0][:most]
    anyone = re.compile(r"\b(?:" + "|".join(re.escape(w) for line in identities for w in line) + r")\b", re.IGNORECASE)
    named = [t for t in texts if anyone.search(t)]
    if named:
        chosen = np.union1d(chosen, np.unique(features([w for line in identities for w in line])[1]))
    if not len(chosen):
        return empty
    column = np.full(BUCKETS, -1)
    column[chosen] = np.arange(len(chosen))
    x = _matrix(texts, column, len(chosen))
    moved = _changes(named, identities, column, len(chosen))
    scale = 1.0 / (1.0 + x.deviations())
    x.values, moved.values, weights = x.values * scale[x.columns], moved.values * scale[moved.columns], weights / weights.sum()
    w, b = np.zeros(len(chosen)), float(empty["bias"])
    mean, square, mean_b, square_b = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, ROUNDS + 1):
        error = (1 / (1 + np.exp(-np.clip(x.times(w) + b, -30, 30))) - labels) * weights
        slope, slope_b = x.transposed_times(error) + DECAY * w, float(error.sum())
        if moved.shape[0]:
            slope += swap_weight * 2 * moved.transposed_times(moved.times(w)) / moved.shape[0]
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope * slope
        mean_b, square_b = 0.9 * mean_b + 0.1 * slope_b, 0.99 * square_b + 0.01 * slope_b * slope_b
        up, root = 1 - 0.9 ** step, 1 - 0.99 ** step
        w -= RATE * (mean / up) / (np.sqrt(square / root) + 1e-8)
        b -= RATE * (mean_b / up) / (np.sqrt(square_b / root) + 1e-8)
    return {"at": chosen, "weights": w * scale, "bias": np.array(b)}


def distinct_features(rows: DataFrame) -> DataFrame:
    """(doc_id, key, found) of ``rows`` (doc_id, text, key): the features of each text, each once, in order and packed."""
    kinds = dict(rows.dtypes)

    def run(batches):
        for batch in batches:
            for part, _, _ in X.chunks(batch):
                text_of, keys = features(part.column(1).to_pylist())
                pairs = np.unique(text_of.astype(np.int64) * BUCKETS + keys)
                edges = np.searchsorted(pairs, np.arange(part.num_rows + 1) * BUCKETS)
                found = [pack_sorted((pairs[a:b] % BUCKETS).astype(np.uint32)) for a, b in zip(edges[:-1], edges[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(found, pa.binary())], names=["doc_id", "key", "found"])

    return rows.select("doc_id", "text", "key").mapInArrow(run, f"doc_id {kinds['doc_id']}, key bigint, found binary")


def frequencies(labelled: DataFrame) -> np.ndarray:
    """How many texts of each class have each feature, over all rows of ``labelled`` (found, label, share); ``share`` counts a text as less
    than one. Summed by Spark."""
    def run(batches):
        total = np.zeros((2, BUCKETS))
        for batch in batches:
            labels, shares = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            for found, label, share in zip(batch.column(0), labels.astype(np.int64), shares):
                total[label, unpack_sorted(found.as_py(), np.uint32)] += share
        at = np.flatnonzero(total.reshape(-1))
        yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int32()), "n": pa.array(total.reshape(-1)[at])})

    sums = labelled.select("found", "label", "share").mapInArrow(run, "at int, n double").groupBy("at").agg(F.round(F.sum("n")).alias("n"))
    counted = sums.toArrow()  # 2 x BUCKETS rows at most
    found = np.zeros(2 * BUCKETS)
    found[counted["at"].to_numpy()] = counted["n"].to_numpy()
    return found.reshape(2, BUCKETS)


def train(documents: DataFrame, marks: DataFrame, per_class: int = TRAIN_TEXTS, swap_weight: float = SWAP_WEIGHT, identities: tuple = IDENTITIES, most: int = FEATURES) -> dict[str, np.ndarray]:
    """The classifier learned from ``documents`` (doc_id, text) and ``marks`` (doc_id, label); labels other than 0 and
    1 and null texts are left out.

    Features are ranked by their frequencies in all labelled texts, copies within a class counted once; the first
    ``most`` that the sample of ``per_class`` texts has get a weight.
    """
    rows = documents.where("text is not null").withColumn("key", F.xxhash64("text"))
    keyed = rows.select("doc_id", "key").join(marks.where("label in (0, 1)"), "doc_id").groupBy("label", "key", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    heads = materialise(keyed.groupBy("label", "key").agg(F.min(F.struct("doc_id", "n")).alias("head")).select("label", "key", "head.doc_id", (1 / F.col("head.n")).alias("share")))
    sample, sizes = labelled_sample(heads, rows, per_class, 2 * per_class)
    counts = {r["label"]: r["n"] for r in sizes.collect()}  # two rows at most
    # Both sides are shuffled at every size; what moves of a text are its features.
    met = distinct_features(rows).join(heads.hint("merge"), ["doc_id", "key"])
    ranked = screened(frequencies(met), (counts[0], counts[1])) if len(counts) == 2 else None

    def run(batches):
        pairs = []
        for batch in batches:
            pairs += zip(batch.column(1).to_pylist(), batch.column(0).to_pylist())
        pairs.sort()
        labels = np.array([k for k, _ in pairs], np.int64)
        taken = {k: max(1, int((labels == k).sum())) for k in (0, 1)}
        weights = np.array([counts[k] / taken[k] for k in labels.tolist()])
        model = fit([t for _, t in pairs], labels, weights, swap_weight, identities, ranked, most)
        yield pa.RecordBatch.from_pydict({"name": list(model), "data": [_packed(v) for v in model.values()]}, schema=pa.schema([("name", pa.string()), ("data", pa.binary())]))

    parts = sample.select("text", "label").coalesce(1).mapInArrow(run, "name string, data binary").collect()
    return {r["name"]: _unpacked(r["data"]) for r in parts} or fit([], np.zeros(0, np.int64), np.zeros(0))


def toxicity(documents: DataFrame, model) -> DataFrame:
    """(doc_id, score, predicted) for each row of ``documents``; ``model`` is a broadcast of what ``train``
    returned. Null and empty texts get the score of a text without words."""
    rows = pick(documents, doc_id="doc_id", text="text")

    def run(batches):
        line = model.value
        weights = np.zeros(BUCKETS)
        weights[line["at"]] = line["weights"]
        for batch in batches:
            for part, _, _ in X.chunks(batch):
                text_of, keys = features(pc.fill_null(part.column(1), "").to_pylist())
                total = np.bincount(text_of, weights[keys], minlength=part.num_rows) + float(line["bias"])
                score = 1 / (1 + np.exp(-np.clip(total, -40, 40)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def score_documents(documents: DataFrame, labels: DataFrame, per_class: int = TRAIN_TEXTS, most: int = FEATURES) -> DataFrame:
    """``toxicity`` with a classifier learned from the labelled rows that are not held out.

    Of several labels of a document the highest counts; a document without label or id teaches nothing.
    """
    rows = pick(documents, doc_id="doc_id", text="text")
    outside = held_out(F.col("doc_id"), 5, 0)
    marks = pick(labels, doc_id="doc_id", toxic="toxic").where("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    model = train(rows.where(~outside), marks, per_class, most=most)
    context = documents.sparkSession.sparkContext
    return toxicity(rows, context.broadcast(model)).withColumn("held_out", outside).select("doc_id", "held_out", "score", "predicted")
