"""Every registered query against its SQL on the smallest tables."""

import datetime

import duckdb
import pytest

from bedtide.plans.oracle import ORACLE
from bedtide.plans.queries import REGISTERED

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(rows):
    text = lambda v: "NULL" if v is None else f"{float(v):.9g}" if isinstance(v, (int, float)) else str(v)
    return sorted(tuple(text(v) for v in row) for row in rows)


@pytest.fixture(scope="module")
def duck(small_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{small_dir}/{name}.parquet')")
    return connection


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(REGISTERED)
    assert set(REGISTERED) - set(ORACLE) == {"model_metrics", "gbt_forecast", "gbt_alerts", "gbt_what_if"}


@pytest.mark.parametrize("name", [n for n in ORACLE if n != "gbt_checks"])  # the full learner takes minutes; the driver runs it
def test_query_matches_sql(spark, small_dir, duck, name):
    result = REGISTERED[name](spark, small_dir)
    assert not any(isinstance(v, datetime.datetime) for v in result.first() or ())
    cursor = duck.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(result.columns)
    assert normal(result.select(columns).collect()) == normal(cursor.fetchall())
