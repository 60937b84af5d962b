"""Language identification with a linear-chain conditional random field over the words of a text.

Every word gets a score for each language from its affixes, its character n-grams and itself (the lexicon),
all hashed to one table of weights; learned transitions join neighbouring words, so that a code-switched text
keeps its stretches apart. Forward-backward gives each word's posterior, and the text's language is the one
with the highest mean posterior.

The field is fitted on a bounded sample of labelled texts, in one task. Its sequences are stretches of those
texts, half of them spliced from several texts, from which the transitions are learned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bedtide.llm import text as X
from bedtide.llm.frames import pick
from bedtide.session import materialise

BUCKETS = 1 << 18
TRAIN_TEXTS, TRAIN_TOTAL = 250, 4000  # labelled texts of each language, and of all, about
# With more weights than this a language has weights only for the features of its own texts. Words x languages at a time.
WEIGHTS, ENTRIES = 1 << 23, 1 << 22
WEIGHT = np.dtype([("language", "<i4"), ("row", "<i4"), ("weight", "<f4")])
SEQUENCE, STRETCH = 64, 16
ROUNDS, RATE, DECAY = 25, 0.4, 1e-4
AFFIXES, GRAMS = (1, 2, 3), (2, 3, 4)
UNKNOWN = "und"

LETTERS = X.byte_class(lambda b: 0x61 <= b <= 0x7A or b >= 0x80)


def word_features(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word index, weight row) of every feature of the words body[start:end]."""
    lengths = ends - starts
    which = np.repeat(np.arange(len(starts)), lengths)
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    packed = body[np.repeat(starts, lengths) + place].astype(np.uint64) + np.uint64(1)
    left = lengths[which] - place
    word, keys = [np.arange(len(starts))], [X.mix(X.span_hashes(body, starts, ends) + np.uint64(1))]
    gram = packed.copy()
    for n in range(1, max(*AFFIXES, *GRAMS) + 1):
        if n > 1:
            gram = gram[:len(packed) - n + 1] * np.uint64(257) + packed[n - 1:] if len(packed) >= n else gram[:0]
        fits = left[:len(gram)] >= n
        code = X.mix(gram + (np.uint64(n) << np.uint64(56)))
        for kind, chosen in (
            (1, fits & (n in GRAMS)), (2, fits & (place[:len(gram)] == 0) & (n in AFFIXES)), (3, fits & (left[:len(gram)] == n) & (n in AFFIXES)),
        ):
            at = np.flatnonzero(chosen)
            word.append(which[at])
            keys.append(X.mix(code[at] + np.uint64(kind)))
    return np.concatenate(word), (np.concatenate(keys) & np.uint64(BUCKETS - 1)).astype(np.int64)


class Words:
    """Lower-case words of some texts: for each word its type, for each type its features."""

    def __init__(self, texts: list[str]):
        raw = [t.lower().encode() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        body = np.frombuffer(b"".join(raw), np.uint8)
        starts, ends, self.firsts = X.word_bounds(body, offsets, LETTERS)
        _, at, self.types = np.unique(X.span_hashes(body, starts, ends), return_index=True, return_inverse=True)
        self.word, self.row = word_features(body, starts[at], ends[at])
        self.n_types = len(at)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """(type, language), the mean weight of the type's features; ``weights`` are WEIGHT rows in order."""
        edges = np.searchsorted(weights["language"], np.arange(int(weights["language"].max(initial=-1)) + 2))
        return _scores(self.word, self.row, self.n_types, edges, weights["row"], weights["weight"])


def _scores(word, row, n_types, edges, rows, values) -> np.ndarray:
    size, out = np.bincount(word, minlength=n_types), np.zeros((n_types, len(edges) - 1))
    for c, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        column = np.zeros(BUCKETS + 1)
        column[rows[a:b]] = values[a:b]
        out[:, c] = np.bincount(word, column[row], minlength=n_types)
    return out / np.sqrt(np.maximum(size, 1))[:, None]


def posteriors(scores: np.ndarray, firsts: np.ndarray, moves: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward for all texts at once: (word, language) posteriors, and for each word after a first
    one the expected moves into it, summed over all words as (from, to)."""
    sizes = np.diff(firsts)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = firsts[:-1][order], sizes[order]
    emission = np.exp(scores - scores.max(axis=1, keepdims=True))
    move = np.exp(moves - moves.max())
    forward, backward = np.empty_like(emission), np.empty_like(emission)
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(1, longest + 1), "right")  # texts with more than t words
    state = None
    for t in range(longest):
        at = starts[:active[t]] + t
        state = emission[at] * (np.exp(begin - begin.max()) if t == 0 else state[:active[t]] @ move)
        state /= state.sum(axis=1, keepdims=True)
        forward[at] = state
    flow = np.zeros_like(move)
    state = np.zeros((0, emission.shape[1]))
    for t in range(longest - 1, -1, -1):
        at = starts[:active[t]] + t
        now = np.ones((active[t], emission.shape[1]))
        if len(state):
            ahead = emission[at[:len(state)] + 1] * state
            now[:len(state)] = ahead @ move.T
            before = forward[at[:len(state)]]
            flow += move * ((before / ((before @ move) * ahead).sum(axis=1, keepdims=True)).T @ ahead)
        state = now / now.sum(axis=1, keepdims=True)
        backward[at] = state
    both = forward * backward
    return both / np.maximum(both.sum(axis=1, keepdims=True), 1e-300), flow


def fit(texts: list[str], labels: list[str]) -> dict[str, np.ndarray]:
    """Weights, moves and beginnings by gradient ascent (Adam) on the conditional likelihood."""
    names = sorted(set(labels))
    words = Words(texts)
    truth = np.repeat(np.array([names.index(x) for x in labels], np.int64), np.diff(words.firsts))
    owner = np.repeat(np.arange(len(texts)), np.diff(words.firsts))
    # Stretches of STRETCH words of one text; every second sequence takes its stretches at random.
    cut = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
    inner = np.arange(len(owner)) - (cut[np.cumsum(np.isin(np.arange(len(owner)), cut)) - 1] if len(owner) else 0)
    block = np.cumsum(inner % STRETCH == 0) - 1
    pieces = np.split(np.arange(len(owner)), np.flatnonzero(np.diff(block)) + 1) if len(owner) else []
    dice = np.random.default_rng(7)
    half = len(pieces) // 2
    sequence = [pieces[i] for i in range(half)] + [pieces[half + i] for i in dice.permutation(len(pieces) - half)]
    order = np.concatenate(sequence) if sequence else np.zeros(0, np.int64)
    types, truth = words.types[order], truth[order]
    firsts = np.unique(np.concatenate([np.arange(0, len(order), SEQUENCE), [len(order)]]))
    first = np.zeros(len(order) + 1, bool)
    first[firsts] = True
    n = len(names)
    rows, edges = _places(words, types, truth, n)
    model = [np.zeros(len(rows)), np.zeros((n, n)), np.zeros(n)]
    follow = np.flatnonzero(~first[1:-1]) + 1
    real_flow = np.zeros((n, n))
    np.add.at(real_flow, (truth[follow - 1], truth[follow]), 1)
    means, squares = [np.zeros_like(m) for m in model], [np.zeros_like(m) for m in model]
    total = max(len(order), 1)
    slices = list(_slices(words, types, truth, firsts, n))
    for step in range(1, ROUNDS + 1):
        if not len(order):
            break
        slope, flow, starts = np.zeros(len(rows)), np.zeros((n, n)), np.zeros(n)
        for word, row, size, kinds, true, ends in slices:
            post, moved = posteriors(_scores(word, row, len(size), edges, rows, model[0])[kinds], ends, model[1], model[2])
            error = -post
            error[np.arange(len(true)), true] += 1
            for c, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                by_type = np.bincount(kinds, error[:, c], minlength=len(size)) / size
                slope[a:b] += np.bincount(row, by_type[word], minlength=BUCKETS + 1)[rows[a:b]]
            flow += moved
            starts += error[ends[:-1]].sum(axis=0)
        slopes = [slope / total - DECAY * model[0] / BUCKETS, (real_flow - flow) / total - DECAY * model[1], starts / total - DECAY * model[2]]
        for i, g in enumerate(slopes):
            means[i] = 0.9 * means[i] + 0.1 * g
            squares[i] = 0.99 * squares[i] + 0.01 * g * g
            model[i] += RATE * (means[i] / (1 - 0.9 ** step)) / (np.sqrt(squares[i] / (1 - 0.99 ** step)) + 1e-8)
    weights = np.zeros(len(rows), WEIGHT)
    weights["language"], weights["row"], weights["weight"] = np.repeat(np.arange(n), np.diff(edges)), rows, model[0]
    return {"weights": weights, "moves": model[1], "begin": model[2], "names": np.array(names)}


def _places(words: Words, types: np.ndarray, truth: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Weight rows of each language one after another, and where each language begins. Every language has all rows
    of the sample, or its own ones if these are too many, and the unused row BUCKETS, so that none is without."""
    seen = np.unique(words.row)
    found = []
    for c in range(n):
        own = seen
        if n * len(seen) > WEIGHTS:
            member = np.zeros(words.n_types, bool)
            member[types[truth == c]] = True
            own = np.unique(words.row[member[words.word]])
        found.append(np.append(own, BUCKETS).astype(np.int32))
    return np.concatenate([np.zeros(0, np.int32), *found]), np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)


def _slices(words: Words, types: np.ndarray, truth: np.ndarray, firsts: np.ndarray, n: int):
    """Some sequences at a time, with the features of their types: (type, row) of each feature, root of the number of
    features of each type, type and truth of each word, bounds of the sequences."""
    step = max(1, ENTRIES // (SEQUENCE * max(1, n)))
    for a in range(0, len(firsts) - 1, step):
        bounds = firsts[a:a + step + 1]
        used, kinds = np.unique(types[bounds[0]:bounds[-1]], return_inverse=True)
        place = np.full(words.n_types, -1)
        place[used] = np.arange(len(used))
        word = place[words.word]
        word, row = word[word >= 0], words.row[word >= 0]
        yield word, row, np.sqrt(np.maximum(np.bincount(word, minlength=len(used)), 1)), kinds, truth[bounds[0]:bounds[-1]], bounds - bounds[0]


def labelled_sample(keyed: DataFrame, texts: DataFrame, per_label: int, total: int) -> tuple[DataFrame, DataFrame]:
    """Texts of a bounded sample as (label, text), and the number ``n`` of different texts of each label.

    ``keyed`` has label and key, the xxhash64 of the text that ``texts`` has. About ``per_label`` different texts of
    each label are taken, about ``total`` in all but one of each label at least (all where there are fewer): those whose
    hash lies in the lowest n-th part, and the lowest, so the same at every run. Only hashes are shuffled and joined; the
    chosen ones are written, small as they are, and the texts are filtered where they are read. Copies are merged.
    """
    pairs = materialise(keyed.select("label", "key").distinct())
    sizes = materialise(pairs.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lowest")))
    share = max(1, min(per_label, total // max(1, sizes.count())))
    unit = (F.col("key").cast("double") + 2.0 ** 63) / 2.0 ** 64
    chosen = materialise(pairs.join(sizes, "label").where((unit * F.col("n") < share) | (F.col("key") == F.col("lowest"))).select("label", "key").coalesce(1))
    found = texts.select("text", F.xxhash64("text").alias("key")).join(chosen, "key")
    return found.groupBy("label", "key").agg(F.min("text").alias("text")).select("label", "text"), sizes


def train(labelled: DataFrame, per_label: int = TRAIN_TEXTS, total: int = TRAIN_TOTAL) -> dict[str, np.ndarray]:
    """The field learned from columns text and label (null in either is left out).

    Every label that occurs is learned, from about ``per_label`` texts, or fewer so that all have about ``total``. The
    result holds at most WEIGHTS weights, or as many as the sample has features by language. Without any labelled
    text it has no names.
    """
    rows = labelled.where("text is not null and label is not null").select("text", "label")
    sample, _ = labelled_sample(rows.select("label", F.xxhash64("text").alias("key")), rows, per_label, total)

    def run(batches):
        texts, labels = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            labels += batch.column(1).to_pylist()
        model = fit([t for _, t in sorted(zip(labels, texts))], sorted(labels))
        yield pa.RecordBatch.from_pydict({"name": list(model), "data": [_packed(v) for v in model.values()]}, schema=pa.schema([("name", pa.string()), ("data", pa.binary())]))

    parts = sample.select("text", "label").coalesce(1).mapInArrow(run, "name string, data binary").collect()
    return {r["name"]: _unpacked(r["data"]) for r in parts} or fit([], [])


def _packed(array: np.ndarray) -> bytes:
    import io

    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def _unpacked(data: bytes) -> np.ndarray:
    import io

    return np.load(io.BytesIO(data), allow_pickle=False)


def language(documents: DataFrame, model, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score, n_words, n_switches) and ``carry`` for each row of ``documents``; ``model`` is a
    broadcast of what ``train`` returned.

    ``score`` is the mean posterior of the language, ``n_switches`` counts neighbouring words with different
    most likely languages. Null, empty and letterless texts are ``und`` with score 0, as are all texts if
    nothing was learned.
    """
    rows = pick(documents, doc_id="doc_id", text="text", **{f"carry_{i}": c for i, c in enumerate(carry)})
    others = [f for f in rows.schema.fields if f.name.startswith("carry_")]
    schema = ", ".join([f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, n_words bigint, n_switches bigint",
                        *(f"{f.name} {f.dataType.simpleString()}" for f in others)])

    def run(batches):
        field = model.value
        names = field["names"].tolist()
        weights = field["weights"]
        limit = X.CHUNK_BYTES * 16 // max(16, len(names))
        for batch in batches:
            for part, _, _ in X.chunks(batch, limit=limit):
                texts = pc.fill_null(part.column(1), "").to_pylist()
                words = Words(texts)
                sizes = np.diff(words.firsts)
                pred, score, switches = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
                if names and sizes.sum():
                    post, _ = posteriors(words.scores(weights)[words.types], words.firsts, field["moves"], field["begin"])
                    total = np.concatenate([np.zeros((1, len(names))), np.cumsum(post, axis=0)])
                    mean = (total[words.firsts[1:]] - total[words.firsts[:-1]]) / np.maximum(sizes, 1)[:, None]
                    best = post.argmax(axis=1)
                    changed = np.concatenate([[0], np.cumsum(np.concatenate([[False], best[1:] != best[:-1]]))])
                    for i in np.flatnonzero(sizes):
                        if texts[i].isascii() or any(c.isalpha() for c in texts[i]):
                            at = int(mean[i].argmax())
                            pred[i], score[i] = names[at], min(1.0, max(0.0, mean[i, at]))
                            switches[i] = changed[words.firsts[i + 1]] - changed[words.firsts[i] + 1]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(pred, pa.string()), pa.array(score), pa.array(sizes.astype(np.int64)), pa.array(switches), *part.columns[2:]],
                    names=["doc_id", "lang_pred", "score", "n_words", "n_switches", *(f.name for f in others)],
                )

    return rows.mapInArrow(run, schema).withColumnsRenamed({f"carry_{i}": c for i, c in enumerate(carry)})


def held_out(doc_id, folds: int, fold: int):
    """Whether the checksum of the id, as text, falls in ``fold``; never null."""
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold, F.lit(False))


def identify(documents: DataFrame, per_label: int = TRAIN_TEXTS, carry: tuple[str, ...] = (), total: int = TRAIN_TOTAL) -> DataFrame:
    """``language`` with a field learned from the texts and ``lang`` of the rows that are not held out."""
    rows = pick(documents, doc_id="doc_id", text="text", lang="lang")
    outside = held_out(F.col("doc_id"), 4, 2)
    model = train(rows.where(~outside).select("text", F.col("lang").alias("label")), per_label, total)
    context = documents.sparkSession.sparkContext
    return language(documents, context.broadcast(model), carry).withColumn("held_out", outside).select(
        "doc_id", "held_out", "lang_pred", "score", "n_words", "n_switches", *carry
    )
