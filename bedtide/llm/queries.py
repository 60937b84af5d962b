"""Registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bedtide.llm import oracle
from bedtide.llm.crf import identify
from bedtide.llm.fertility import quality
from bedtide.llm.fixity import audited_pages
from bedtide.llm.licenses import license_digest, license_spans
from bedtide.llm.raking import mix
from bedtide.llm.resampling import resample
from bedtide.llm.simhash import simhash_groups
from bedtide.llm.spelling import spelling_variants
from bedtide.llm.suffixes import remove_repeats
from bedtide.llm.toxicity import score_documents
from bedtide.llm.trie_tokens import token_counts
from bedtide.llm.wavelets import token_files
from bedtide.llm.winnow import contamination
from bedtide.session import utc


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return utc(spark).read.parquet(f"{sf}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return license_digest(license_spans(table(spark, sf, "documents")))


def op2_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return remove_repeats(table(spark, sf, "documents"), with_text=False)


def op3_mixing(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mix(table(spark, sf, "documents"))
    return mixed.withColumns({c: F.round(c, 6) for c in ("weight", "probability", "sample_weight")})


def op4_fixity(spark: SparkSession, sf: str) -> DataFrame:
    return audited_pages(table(spark, sf, "pages")).select("page_id", "length", "status", "hash_a", "hash_b")


def op5_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash_groups(table(spark, sf, "documents"))


def op6_winnow(spark: SparkSession, sf: str) -> DataFrame:
    return contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op7_fertility(spark: SparkSession, sf: str) -> DataFrame:
    return quality(table(spark, sf, "documents"))


def op8_language(spark: SparkSession, sf: str) -> DataFrame:
    return identify(table(spark, sf, "documents"))


def op9_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts(table(spark, sf, "documents"))


def op10_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return score_documents(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op11_spelling(spark: SparkSession, sf: str) -> DataFrame:
    return spelling_variants(table(spark, sf, "documents"))


def op12_resampling(spark: SparkSession, sf: str) -> DataFrame:
    return resample(table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("n_words")


def op13_wavelets(spark: SparkSession, sf: str) -> DataFrame:
    return token_files(table(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in [op1_license_scan, op2_suffix_dedup, op3_mixing, op4_fixity, op5_simhash, op6_winnow, op7_fertility, op8_language, op9_token_counts, op10_toxicity,
                                   op11_spelling, op12_resampling, op13_wavelets]}
SQL = {"op2_suffix_dedup": oracle.SUFFIXES, "op3_mixing": oracle.MIXING, "op4_fixity": oracle.FIXITY, "op6_winnow": oracle.CONTAMINATION,
       "op11_spelling": oracle.SPELLING, "op12_resampling": oracle.RESAMPLING}
