"""Golden rows of FIXTURES.md §4 for the text operators (stop words: the, and, is)."""

import pytest
from pyspark.sql import functions as F

from postcred.functions import text as T
from postcred.operators import text as TX

SW = ["the", "and", "is"]

GOLDEN = [
    # text, clean tokens, entropy, pmi (on the same tokens), text after URL + mention strip
    ("The cat, the, CAT! sat", ["cat", "the", "cat", "sat"], 1.5, 1.415037, "The cat, the, CAT! sat"),
    ("", [], 0.0, 0.0, ""),
    ("wow", ["wow"], 0.0, 0.0, "wow"),
    ("\U0001F389\U0001F389\U0001F389 ok 12345 a1b2", ["", "a1b2"], 1.0, 0.0, "\U0001F389\U0001F389\U0001F389 ok 12345 a1b2"),
    ("see http://t.co/x https://t.co/y", ["see", "httptcox"], 1.0, 0.0, "see"),
    ("aaa bbb aaa bbb", ["aaa", "bbb", "aaa", "bbb"], 1.0, 1.081704, "aaa bbb aaa bbb"),
    ("aaa bbb ccc", ["aaa", "bbb", "ccc"], 1.584963, 0.0, "aaa bbb ccc"),
    ("@bob hello e.g. wait... ok", ["bob", "hello", "wait"], 1.584963, 0.0, "hello ok"),
]


@pytest.fixture(scope="module")
def golden(spark):
    rows = [(str(i), "t", txt) for i, (txt, *_rest) in enumerate(GOLDEN)]
    df = spark.createDataFrame(rows, "screen_name string, created_at string, text string")
    d = TX.with_text_stats(TX.with_tokens(df, stopwords=SW))
    d = TX.with_url_mention_strip(d)
    return {r["screen_name"]: r for r in d.collect()}


def test_clean_tokens(golden):
    for i, (_, toks, *_rest) in enumerate(GOLDEN):
        assert golden[str(i)]["tokens"] == toks, GOLDEN[i][0]


def test_entropy_and_pmi(golden):
    for i, (_, _, h, pmi, _s) in enumerate(GOLDEN):
        assert golden[str(i)]["entropy"] == pytest.approx(h, abs=1e-6)
        assert str(golden[str(i)]["entropy"]) != "-0.0"
        assert golden[str(i)]["pmi"] == pytest.approx(pmi, abs=1e-6)


def test_url_mention_strip(golden):
    for i, (*_rest, stripped) in enumerate(GOLDEN):
        assert golden[str(i)]["text_stripped"] == stripped


def test_newline_text(spark):
    df = spark.createDataFrame([("a", "t", "line one\nline two")], "screen_name string, created_at string, text string")
    d = TX.with_tokens(TX.with_stored_text(df), "stored_text", "lt", SW)
    d = TX.with_tokens(d, stopwords=SW)
    r = d.collect()[0]
    assert r["tokens"] == ["line", "one", "line", "two"]
    assert r["lt"] == ["line", "oneline", "two"]
    s = TX.with_url_mention_strip(df).collect()[0]
    assert s["text_stripped"] == "line one line two"


def test_drop_row_policy(spark):
    df = spark.createDataFrame([("a", "t", "@bob hello"), ("b", "t", "plain @ word"), ("c", "t", "mail x@y")],
                               "screen_name string, created_at string, text string")
    kept = {r["screen_name"]: r["text_stripped"] for r in TX.with_url_mention_strip(df, policy="drop_row").collect()}
    assert set(kept) == {"b"}
    assert kept["b"] == "plain word"


def test_unicode_whitespace_split(spark):
    df = spark.createDataFrame([("x yyy　zzz www ",)], "t string")
    assert df.select(T.split_ws("t")).first()[0] == ["x", "yyy", "zzz", "www"]
    assert df.select(T.strip_ws("t")).first()[0] == "x yyy　zzz www"


def test_token_and_bigram_counts(spark):
    df = spark.createDataFrame([("a", "t", "aaa bbb aaa bbb"), ("b", "t", "aaa bbb ccc")],
                               "screen_name string, created_at string, text string")
    d = TX.with_tokens(df, stopwords=SW)
    tc = {(r["screen_name"], r["term"]): r["n"] for r in TX.token_counts(d).collect()}
    assert tc == {("a", "aaa"): 2, ("a", "bbb"): 2, ("b", "aaa"): 1, ("b", "bbb"): 1, ("b", "ccc"): 1}
    bc = {(r["screen_name"], r["w1"], r["w2"]): r["n"] for r in TX.bigram_counts(d).collect()}
    # only posts with more than 3 tokens get bigrams
    assert bc == {("a", "aaa", "bbb"): 2, ("a", "bbb", "aaa"): 1}


def test_default_stopwords_are_179():
    assert len(T.ENGLISH_STOPWORDS) == 179
    assert len(set(T.ENGLISH_STOPWORDS)) == 179
