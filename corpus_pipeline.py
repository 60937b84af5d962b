"""From raw documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns of ``documents``; the
last one adds the weights. ``run`` writes what a stage returns as Parquet and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bedtide.llm.crf import UNKNOWN, identify
from bedtide.llm.frames import pick
from bedtide.llm.raking import mix
from bedtide.llm.simhash import representatives
from bedtide.llm.suffixes import remove_repeats
from bedtide.llm.winnow import contamination
from bedtide.session import materialise, utc

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return pick(docs, **{c: c for c in COLUMNS})


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language, which becomes their ``lang``. Null and letterless texts go; a text shared by
    several languages stays, however low the mean posterior of each."""
    found = identify(_documents(docs), carry=("text", "source", "n_chars"))
    return found.where(F.col("lang_pred") != UNKNOWN).withColumnRenamed("lang_pred", "lang").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: that with the smallest doc_id. Of repeated rows one stays."""
    rows = _documents(docs).withColumn("text_key", F.xxhash64("text"))
    heads = materialise(representatives(rows).withColumnsRenamed({"doc_id": "head_id", "text_key": "head_key"}))
    kept = rows.join(heads, rows["doc_id"].eqNullSafe(heads["head_id"]) & (rows["text_key"] == heads["head_key"]), "left_semi")
    place = F.row_number().over(Window.partitionBy("doc_id", "text_key").orderBy("lang", "source", "n_chars"))
    return kept.withColumn("place", place).where(F.col("place") == 1).select(*COLUMNS)


def repeated_strings_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without strings that an earlier one has; those of which nothing but white space is left go."""
    cut = remove_repeats(_documents(docs), carry=("lang", "source", "n_chars"))
    changed = F.col("n_removed") > 0
    return cut.where(~changed | (F.trim(F.regexp_replace("kept", r"\s+", " ")) != "")).select(
        "doc_id", F.col("kept").alias("text"), "lang", "source",
        F.when(changed, F.length("kept").cast("bigint")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark items."""
    rows = _documents(docs).withColumn("text_key", F.xxhash64("text"))
    benchmark = utc(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    bad = contamination(rows, benchmark, with_key=True).where("contaminated")
    bad = materialise(bad.select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key")).distinct())
    return rows.join(bad, rows["doc_id"].eqNullSafe(bad["bad_id"]) & (rows["text_key"] == bad["bad_key"]), "left_anti").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with the target shares of sources, languages and topics, with its weights."""
    mixed = mix(_documents(docs), carry=("text", "n_chars"))
    return mixed.where("sampled").select(*COLUMNS, "topic", "tokens", *(F.round(c, 6).alias(c) for c in ("weight", "probability", "sample_weight")))


STAGES = [
    ("language_id", language_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("suffix_dedup", repeated_strings_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = utc(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
