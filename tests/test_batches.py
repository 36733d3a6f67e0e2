"""Tokens and statistics over Arrow batches equal the built-in expressions; lookups move numbers instead of texts; captures meet in one task."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postcred.functions import batches as AB
from postcred.functions.text import clean_tokens, strip_newlines
from postcred.operators import blocks as B
from postcred.operators import lexicon as LX
from postcred.operators import text as TX
from postcred.operators.topics import topic_doc_weight
from postcred.plans import pipeline as P
from postcred.sources.adapter import capture_lines
from postcred.sources.captures import filter_originals, parse_posts, project_original

PARTS = ["The", "it's", "cat,", "12345", "a1b2", "٣٤٥٦", "🎉🎉🎉", "http://t.co/x", "https://a", "ÉTÉ", "İstanbul", "x", "--", "ab", "a-b-c", "{{z}}", "_under_", "日本語", "and", "And,", "ΟΔΟΣ", "½½½"]


def texts():
    rng = random.Random(5)
    some = ["".join(rng.choice(PARTS) + rng.choice([" ", "\n", "\t ", " ", "　", "\x85"]) for _ in range(rng.randint(1, 60))) for _ in range(200)]
    return ["", " ", None, "the and is", "🎉🎉🎉", " cat ", "cat cat cat cat", "cat dog cow hen", "cat dog cow", *some]


@pytest.mark.parametrize("work_bytes", [4 << 20, 300])
def test_batches_equal_the_expressions(spark, monkeypatch, work_bytes):
    monkeypatch.setattr(AB, "WORK_BYTES", work_bytes)
    d = spark.createDataFrame([(t,) for t in texts()], "text string").repartition(3)
    d = TX.with_text_stats(d.withColumn("tokens", clean_tokens("text")))
    d = d.withColumn("now", AB.clean_tokens_and_entropy("text")).withColumn("now_pmi", AB.pmi_of_text("text"))
    for r in d.collect():
        assert r.now.tokens == r.tokens
        assert r.now.entropy == pytest.approx(r.entropy, abs=1e-12)
        assert r.now_pmi == pytest.approx(r.pmi, abs=1e-12)


def test_numbers_are_read_back():
    numbers = np.array([0, 1, 127, 128, 16383, 16384, 2097151, 2097152, (1 << 28) - 1, 5])
    data, size = B.packed(numbers)
    back, end = B.unpacked(data)
    assert back.tolist() == numbers.tolist() and np.diff(end, prepend=0).tolist() == size.tolist() == [1, 1, 1, 2, 2, 3, 3, 4, 4, 1]
    assert [len(x) for x in (*B.packed(numbers[:0]), *B.unpacked(data[:0]))] == [0, 0, 0, 0]


def test_lookups_move_numbers_not_texts(spark, monkeypatch):
    """2 000 words of 10 letters and more: a post's row holds a byte for each."""
    posts = spark.range(20).select(F.col("id").cast("string").alias("screen_name"), F.lit("t").alias("created_at"),
                                   F.array_join(F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.concat(F.lit("wordwordword"), i.cast("string"))), " ").alias("text")).repartition(2)
    lex = spark.range(100).select(F.concat(F.lit("wordwordword"), "id").alias("term"), F.lit(1).alias("score"), F.lit("word").alias("kind"))
    seen, real = {}, B.written
    monkeypatch.setattr(B, "written", lambda df, name: seen.setdefault(name, real(df, name)))
    assert {r["positive"] for r in LX.lexicon_sentiment(posts, lex, max_broadcast_rows=0, landed=True).collect()} == {100}
    assert list(seen) == ["lookup-terms"]  # landed posts are not written again
    rows = seen["lookup-terms"].where("_codes IS NOT NULL")
    assert rows.count() == 20 and rows.where("_word IS NOT NULL").count() == 0
    assert rows.agg(F.sum(F.length("_codes"))).first()[0] == 2000


def test_distinct_tokens_of_two_columns_in_one_pass(spark):
    d = spark.createDataFrame([(["a", "b", None], ["b"]), (None, ["c", ""]), ([], ["c"])], "x array<string>, y array<string>").repartition(3)
    assert {(r["_word"], r["_in"]) for r in B.distinct_tokens_of_each(d, ["x", "y"]).collect()} == {("a", 1), ("b", 3), ("c", 2), ("", 2)}


def test_both_captures_of_a_document_come_from_one_scan(spark, sf_small):
    lines = capture_lines(spark, sf_small)
    assert lines._jdf.queryExecution().optimizedPlan().toString().count("doc_id#") and lines._jdf.queryExecution().executedPlan().toString().count("documents.parquet") == 1
    n = spark.read.parquet(f"{sf_small}/documents.parquet").count()
    observed = project_original(filter_originals(parse_posts(lines))).select("screen_name", "created_at", F.spark_partition_id().alias("at"))
    assert observed.count() == 2 * n
    assert observed.groupBy("screen_name", "created_at").agg(F.countDistinct("at").alias("tasks")).where("tasks > 1").count() == 0


def test_landed_tokens_need_no_exchange_downstream(spark, sf_small):
    posts = P.landed_tokens(P.posts_from_tables(spark, sf_small))
    assert posts.columns[-3:] == ["tokens", "entropy", "ltokens"]
    lex = spark.createDataFrame([("cat", 2, "word")], "term string, score int, kind string")
    weights = spark.createDataFrame([("cat", 0.5)], "term string, weight double")
    plan = P.five_feature_frame(posts, lex, weights, landed=True)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan.split("InMemoryRelation")[0] and "ArrowEvalPython" not in plan


def test_otc_needs_no_exchange_after_its_landing(spark, sf_small):
    posts = P.landed_posts(spark, sf_small)
    subj = spark.createDataFrame([("cat", 0.5)], "term string, subjectivity double")
    cats = spark.createDataFrame([("money", "cat")], "category string, term string")
    plan = P.otc_frame(posts, subj, cats)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(screen_name" not in plan and "ArrowEvalPython" not in plan


@pytest.mark.parametrize("work_bytes", [4 << 20, 300])
def test_landed_texts_equal_the_token_arrays(spark, monkeypatch, work_bytes):
    """Entropy and stored tokens as by the expressions, also where a newline's loss changes the small form of a sigma; the terms are the distinct tokens."""
    monkeypatch.setattr(AB, "WORK_BYTES", work_bytes)
    rows = [(str(i), "t", t) for i, t in enumerate([*texts(), "ΑΒΣ\nΑ bbb", "ΟΔΟΣ\nxyz ΣΣΣ\n", "abc\nΣΣΣ", "one\ntwo"])]
    posts = spark.createDataFrame(rows, "screen_name string, created_at string, text string").repartition(3)
    plain = TX.with_text_stats(posts.withColumn("tokens", clean_tokens("text"))).withColumn("ltokens", clean_tokens(strip_newlines("text")))
    expected = {r.screen_name: r for r in plain.collect()}
    landed = P.landed_texts(posts)
    for r in landed.collect():
        assert r.ltokens == (None if r.text is None else " ".join(expected[r.screen_name].ltokens))
        assert r.entropy == pytest.approx(expected[r.screen_name].entropy, abs=1e-12)
    for terms, column in zip(P.landed_terms(landed), ("tokens", "ltokens")):
        assert sorted(r.term for r in terms.collect()) == sorted({w for e in expected.values() for w in e[column] or []} - {""})


def test_the_features_land_no_token_arrays(spark, sf_small, monkeypatch):
    """What is landed with the posts is a text or a number: arrays of tokens take many times the memory of the text in the sort of the landing."""
    seen, real = [], P.land_posts
    monkeypatch.setattr(P, "land_posts", lambda df, buckets=None: seen.append(df.schema) or real(df, buckets))
    assert P.fixture_five_features(spark, sf_small).count() > 0
    assert len(seen) == 1 and "array" not in seen[0].simpleString()


def test_topic_weights_of_joined_tokens(spark):
    """Tokens joined by a space weigh what their array weighs, by either join; null and empty ones weigh nothing."""
    d = spark.createDataFrame([("a", "1", ["x", "", "y", "x"]), ("b", "1", []), ("c", "1", None), ("d", "1", ["z"])], "screen_name string, created_at string, toks array<string>")
    d = d.withColumn("joined", F.array_join("toks", " "))
    weights = spark.createDataFrame([("x", 0.5), ("y", 2.0)], "term string, weight double")
    expected = {"a": 3.0, "b": 0.0, "c": 0.0, "d": 0.0}
    for n in (0, 1000):
        for column in ("toks", "joined"):
            out = topic_doc_weight(d, weights, tokens=column, max_broadcast_rows=n, unique=True)
            assert {r.screen_name: r.topic_weight for r in out.collect()} == expected
