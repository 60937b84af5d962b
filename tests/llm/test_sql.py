"""Queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from bedtide.llm.queries import QUERIES, SQL

TABLES = "documents pages benchmark labels".split()


def normal(rows):
    text = lambda v: "NULL" if v is None else f"{float(v):.9g}" if isinstance(v, (int, float)) else str(v)
    return sorted(tuple(text(v) for v in row) for row in rows)


@pytest.mark.parametrize("name", list(SQL))
def test_query_matches_sql(spark, small_dir, name):
    folder = small_dir.replace("sf0.001", "sf0.01") if name == "op4_fixity" else small_dir
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    result = QUERIES[name](spark, folder)
    cursor = duck.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(result.columns)
    assert normal(result.select(columns).collect()) == normal(cursor.fetchall())


def test_pipeline_keeps_what_no_stage_rejects(spark, small_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    counts, frame = [docs.count()], docs
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, small_dir)
        path = os.path.join(spark.conf.get("spark.checkpoint.dir"), f"stage-{len(counts)}")
        frame.write.parquet(path)
        frame = spark.read.parquet(path)
        counts.append(frame.count())
    assert counts[1] >= 0.99 * counts[0] and counts == sorted(counts, reverse=True) and counts[-1] > 0
    ids = [r[0] for r in frame.select("doc_id").collect()]
    assert len(ids) == len(set(ids))
