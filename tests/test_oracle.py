"""Registered queries against their DuckDB twins on the smallest driver tables."""

import math

import duckdb
import pytest

import __spark_entry__ as E

TABLES = "documents labels conversations".split()
FAST = ["parse_posts", "dedup_posts", "ingest_counts", "clean_tokens", "strip_mentions", "strip_mentions_drop_row",
        "token_counts", "bigram_counts", "lexicon_sentiment", "category_rates", "retweet_ratio", "token_entropy",
        "pmi_mean", "otc_score", "five_features", "standardize", "fuzzy_memberships", "ordered_split",
        "classification_report"]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.fixture(scope="module")
def con(sf_small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return c


def test_every_sql_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", FAST)
def test_query_matches_duckdb(spark, con, sf_small, name):
    sdf = E.queries()[name](spark, sf_small)
    cols = sorted(sdf.columns)
    srows = sorted((tuple(_norm(r[c]) for c in cols) for r in sdf.collect()), key=repr)
    rel = con.sql(E.oracle_sql()[name])
    idx = [rel.columns.index(c) for c in cols]
    drows = sorted((tuple(_norm(r[i]) for i in idx) for r in rel.fetchall()), key=repr)
    assert sorted(rel.columns) == cols
    assert srows == drows


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["screen_name", "created_at", "nfrq", "positive", "negative", "entropy", "topic_weight"]
    assert df.count() > 0
