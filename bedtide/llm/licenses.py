"""License scan: base phrases, and short notices with a few misspelled, missing or added characters.

Texts are reduced to lower-case words with one space between them. A notice that may carry e edits is cut
into e + 1 pieces; whatever the edits, one piece stays as it is, so an Aho-Corasick automaton over all pieces
finds every place that can match. Only there does the regex library look for the notice with its bounded
number of errors, and says where it is and how many edits it has.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bedtide.llm import text as X
from bedtide.llm.frames import documents_of

BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Opening words of well-known notices (fixed values), as (notice, label).
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under a creative commons attribution", "cc"),
    ("all rights reserved", "reserved"),
)
EDIT_SHARE, MAX_EDITS = 0.08, 4
_SPACED = bytes(int(X.LOWER[b]) if X.PLAIN[X.LOWER[b]] else 0x20 for b in range(256))


def edits_of(notice: str) -> int:
    return min(MAX_EDITS, int(len(notice) * EDIT_SHARE))


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """``edits`` + 1 pieces as (offset, text)."""
    cuts = [round(i * len(notice) / (edits + 1)) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    """The automaton and the patterns, built once in each Python worker."""

    def __init__(self, base: tuple[tuple[str, str], ...], notices: tuple[tuple[str, str], ...]):
        import ahocorasick
        import regex

        self.base, self.notices, self.patterns = base, notices, []
        uses: dict[str, list] = {}
        for phrase, label in base:
            uses.setdefault(f" {phrase} ", []).append((None, label, len(phrase) + 1))
        for i, (notice, _) in enumerate(notices):
            edits = edits_of(notice)
            self.patterns.append((regex.compile(rf"(?e)(?<= )(?:{regex.escape(notice, literal_spaces=True)}){{e<={edits}}}(?= )"), edits))
            for offset, piece in pieces(notice, edits):
                uses.setdefault(piece, []).append((i, offset, len(piece)))
        self.automaton = ahocorasick.Automaton()
        for piece, use in uses.items():
            self.automaton.add_word(piece, use)
        self.automaton.make_automaton()

    def scan(self, words: str) -> list[tuple[int, str, str, int, int]]:
        """(start, kind, label, length, edits) in characters of `` words ``, sorted."""
        found, close, windows = [], [], {}
        for end, uses in self.automaton.iter(words):
            for i, offset, length in uses:
                if i is None:
                    found.append((end - length + 1, "base", offset, length - 1, 0))
                else:
                    slack = self.patterns[i][1]
                    start = end - length + 1 - offset
                    low, high = max(0, start - slack - 1), start + len(self.notices[i][0]) + slack + 1
                    spans = windows.setdefault(i, [])
                    if spans and low <= spans[-1][1]:
                        spans[-1] = (min(spans[-1][0], low), max(high, spans[-1][1]))
                    else:
                        spans.append((low, high))
        for i, spans in windows.items():
            pattern, label = self.patterns[i][0], self.notices[i][1]
            for low, high in merged(spans):
                for m in pattern.finditer(words, low, min(high, len(words))):
                    close.append((sum(m.fuzzy_counts), m.start(), m.end(), label))
        return sorted(found + [(a, "notice", label, b - a, edits) for edits, a, b, label in best(close)])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def best(matches: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """(edits, low, high, label) without those that overlap one with fewer edits: a near notice must not shadow the
    right one."""
    shadowed, open_ = set(), []
    for m in sorted(set(matches), key=lambda m: (m[1], m[2], m[0], m[3])):
        open_ = [o for o in open_ if o[2] > m[1]]
        for o in open_:
            if o[0] != m[0]:
                shadowed.add(max(o, m, key=lambda x: x[0]))
        open_.append(m)
    return sorted(set(matches) - shadowed)


@cache
def scanner(base: tuple, notices: tuple) -> Scanner:
    return Scanner(base, notices)


SPANS = "n_words bigint, spans array<struct<kind:string,label:string,start:bigint,words:bigint,edits:int,score:double,matched:string>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("label", pa.string()), ("start", pa.int64()), ("words", pa.int64()),
                            ("edits", pa.int32()), ("score", pa.float64()), ("matched", pa.string())]))


def license_spans(documents: DataFrame, base: dict[str, str] = BASE, notices: tuple = NOTICES) -> DataFrame:
    """(doc_id, n_words, spans) for each row of ``documents``: every base phrase and every notice found, with its
    first word, its number of words, its edits, one minus edits by length as score, and the words matched.

    Null and empty texts have no words and no spans. Repeated rows stay repeated, a null doc_id stays null.
    Places of one phrase may overlap; matches of one notice don't.
    """
    rows, key = documents_of(documents), (tuple(base.items()), tuple(notices))

    def run(batches):
        search = scanner(*key)
        for batch in batches:
            counts, spans = [], []
            for text in pc.fill_null(batch.column(1), "").to_pylist():
                words = text.encode().translate(_SPACED).split()
                joined = f" {b' '.join(words).decode()} " if words else ""
                counts.append(len(words))
                spans.append([])
                at = word = 0
                for start, kind, label, length, edits in search.scan(joined):
                    word, at = word + joined.count(" ", at, start), start
                    matched = joined[start:start + length]
                    spans[-1].append({"kind": kind, "label": label, "start": word - 1, "words": matched.count(" ") + 1,
                                      "edits": edits, "score": 1 - edits / length, "matched": matched})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(spans, _SPAN)], names=["doc_id", "n_words", "spans"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {SPANS}")


def license_digest(spans: DataFrame) -> DataFrame:
    """One line for each row of ``license_spans``: places and labels of base phrases, labels of all spans, and the
    score of the best span (0 where there is none)."""
    base = F.filter("spans", lambda s: s["kind"] == "base")
    starts = F.transform(base, lambda s: s["start"])
    labels = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda s: s["label"]))), ",")
    return spans.select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"),
        F.size("spans").cast("bigint").alias("n_spans"),
    )
