"""Queries against their SQL statements in DuckDB on the smallest tables.

A few by default; all of them with ORACLE_ALL=1.
"""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

SOME = (
    "f05_f09_strategies", "q01_standardise_clean", "w01_dedup_none", "a08_a17_metric_bundle", "w12_holdout_split",
    "m01_j05_word_tfidf", "q06_score_reviews", "q08_venue_cache", "x02_anomaly_rate",
)
NAMES = sorted(oracle_sql()) if os.environ.get("ORACLE_ALL") else SOME
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return con


def ordered(rows):
    return sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, data, duck, name):
    df = queries()[name](spark, data)
    columns = sorted(df.columns)
    found = duck.execute(oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    want = [tuple(r[i] for i in places) for r in found.fetchall()]
    assert ordered(tuple(r[c] for c in columns) for r in df.collect()) == ordered(want)


def test_entry(spark, data):
    assert entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
