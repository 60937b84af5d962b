"""Every operator and stage on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bedtide.llm import crf, fertility, fixity, licenses, raking, simhash, suffixes, toxicity, trie_tokens, winnow

LONG = " ".join(f"word{i % 977} other{i % 13}" for i in range(30000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from the slow bear today", "en", "a", 10, "x", 0.5),
    (1, "The quick brown fox jumps over the lazy dog and runs away from the slow bear today", "en", "a", 10, "x", 0.5),
    (2, None, "en", None, None, None, None), (3, "", None, "b", 0, "", 1.0), (4, " \n\t", "de", "b", 3, "y", 2.0),
    (None, "Ein Satz ohne Nummer, der trotzdem gelesen wird", "de", "b", 5, "z", 0.0), (None, None, None, None, None, None, None),
    (5, LONG, "en", "a", len(LONG), "q", 1.0), (6, "!!! ??? 123", "en", "a", 11, "q", 1.0), (7, "日本語のテキスト 😀", "ja", "c", 9, "q", 1.0),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, `TEXT` string, score double"
KINDS = {"rows": ROWS, "empty": []}


@pytest.fixture(scope="module", params=list(KINDS))
def hostile(request, spark):
    return spark.createDataFrame(KINDS[request.param], SCHEMA)


@pytest.fixture(scope="module")
def benchmark_items(spark):
    return spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog and runs away from the slow bear"), (2, None), (None, "")], "item_id bigint, text string")


OPERATORS = {
    "licenses": lambda d: licenses.license_digest(licenses.license_spans(d)),
    "suffixes": lambda d: suffixes.remove_repeats(d, carry=("lang", "score")),
    "raking": raking.mix,
    "simhash": simhash.simhash_groups,
    "fertility": fertility.quality,
    "crf": crf.identify,
    "tokens": trie_tokens.token_counts,
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_one_row_for_each_row(hostile, name):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in OPERATORS[name](hostile).select("doc_id").collect())
    assert got == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in hostile.select("doc_id").collect())


def test_contamination(hostile, benchmark_items):
    rows = winnow.contamination(hostile, benchmark_items).collect()
    assert len(rows) == hostile.count()
    if rows:
        assert [r["contaminated"] for r in rows if r["doc_id"] == 1] == [True, True]
        assert not any(r["contaminated"] for r in rows if r["doc_id"] != 1)
    assert not winnow.contamination(hostile, benchmark_items.limit(0)).where("contaminated").count()


def test_toxicity(hostile, spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (5, 0, 0), (None, 0, 1), (7, None, None)], "doc_id bigint, quality int, toxic int")
    for marks in (labels, labels.limit(0)):
        rows = toxicity.score_documents(hostile, marks).collect()
        assert len(rows) == hostile.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert all(r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_fixity(spark):
    pages = spark.createDataFrame([(1, "u", "<p>"), (1, "u", "<p>"), (2, None, None), (None, "v", ""), (3, "w", "x" * 200000)], "page_id bigint, url string, html string")
    for rows in (pages, pages.limit(0)):
        shuffled = fixity.archives(rows.select("page_id", fixity.warc_record(F.col("page_id"), F.col("url"), F.col("html")).alias("record")))
        tree = fixity.merkle_tree(shuffled)
        assert fixity.audit(tree, tree).count() == 0
        assert fixity.audit(tree, fixity.merkle_tree(shuffled.limit(0))).where("status = 'missing'").count() == rows.count()
    assert fixity.audited_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize("at", range(5))
def test_stage(spark, hostile, tmp_path, benchmark_items, at):
    name, stage = corpus_pipeline.STAGES[at]
    benchmark_items.write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = stage(spark, hostile, str(tmp_path))
    rows = kept.collect()
    assert list(kept.columns[:5]) == list(corpus_pipeline.COLUMNS) and len(rows) <= hostile.count()
    if not rows:
        return
    ids = [r["doc_id"] for r in rows]
    if name == "language_id":
        assert sorted(x for x in ids if x) == [1, 1, 5, 7] and None in ids
    if name == "simhash_near_dedup":
        assert ids.count(1) == 1 and 2 in ids and 3 not in ids and 4 not in ids and ids.count(None) == 1
    if name == "suffix_dedup":
        assert ids.count(1) == 2 and next(r["text"] for r in rows if r["doc_id"] == 5) == LONG
    if name == "decontamination":
        assert 1 not in ids and 5 in ids


def test_long_runs_of_white_space(spark):
    rng = random.Random(0)
    bpe, _, _ = fertility.encoders(fertility.vocabulary_folder())
    for _ in range(300):
        text = "".join(rng.choice(["a", "b c", "!", "'s", " " * rng.randint(1, 30), "\n" * rng.randint(1, 9), " \t\r\n　"]) for _ in range(rng.randint(0, 8)))
        few = re.compile(fertility.LONG_BLANKS.pattern.replace("100000", "3"))
        assert fertility.bpe_tokens(*bpe, text, few) == bpe[0].encode_ordinary(text)
    texts = [" " * 3_000_000, "word " + " \n" * 1_500_000 + "word", "x" * 3_000_000, "!" * 3_000_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)
    got = {r.doc_id: r for r in fertility.quality(rows).collect()}
    assert len(got) == 4 and got[0].n_tokens == 3_000_000 and not any(r.kept for r in got.values())
    assert got[1].n_tokens == len(bpe[0].encode_ordinary("word")) + len(bpe[1].encode_ordinary((" " + " \n" * 1_500_000)[:-1])) + len(bpe[0].encode_ordinary("\nword"))
