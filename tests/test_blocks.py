"""Tables beyond the broadcast bound: values looked up block by block equal the broadcast join's, and single words never move."""

import random
import re
import string

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postcred.functions.text import ENGLISH_STOPWORDS, clean_tokens
from postcred.operators import blocks as B
from postcred.operators import lexicon as LX
from postcred.operators.topics import topic_doc_weight
from postcred.plans import pipeline as P

VOCAB = ["good", "bad", "not", ":)", "good/bad", "(Good)", "it's", "é", "wow", "a b", "x\ny", "ΟΔΟΣ", "good,bad,good"]


def posts_of(spark, seed):
    rng = random.Random(seed)
    rows = [(f"u{i % 50}", "t" if i % 7 else None, 1.5, t) for i, t in enumerate(  # keys repeat and are null
        [None, "", " \t ", "good " * 3000] + [" ".join(rng.choices(VOCAB, k=rng.randint(0, 30))) for _ in range(80)])]
    return spark.createDataFrame(rows, "screen_name string, created_at string, pmi double, text string").repartition(5)


def same(a, b):
    a, b = (sorted((tuple(r) for r in d.collect()), key=repr) for d in (a, b))
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert [v for v in x if not isinstance(v, float)] == [v for v in y if not isinstance(v, float)]
        assert [v for v in x if isinstance(v, float)] == pytest.approx([v for v in y if isinstance(v, float)])


@pytest.mark.parametrize("block_bytes", [4 << 20, 200])
def test_blocks_equal_the_broadcast_join(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(B, "BLOCK_BYTES", block_bytes)
    posts = posts_of(spark, 3)
    sent = spark.createDataFrame([("good", 3, "word"), ("good", 1, "word"), ("bad", -3, "word"), (":)", 2, "emoticon"), ("é", None, "word"), (None, 2, "word"), ("οδος", 5, "word"), ("wow", 7, None)],
                                 "term string, score int, kind string")
    subj = spark.createDataFrame([("good", 0.5), ("good", 0.7), ("bad", None), ("it's", 0.25), (None, 1.0)], "term string, subjectivity double")
    cats = spark.createDataFrame([("hate", "bad"), ("money", "good"), ("hate", "good"), ("lust", "wow"), ("other", "é")], "category string, term string")
    weights = spark.createDataFrame([("good", 0.5), ("good", 0.25), ("bad", None), ("wow", 2.0), (None, 1.0)], "term string, weight double")
    for op in (lambda n: LX.lexicon_sentiment(posts, sent, max_broadcast_rows=n), lambda n: LX.lexicon_subjectivity(posts, subj, "text", max_broadcast_rows=n),
               lambda n: LX.category_rates(posts, cats, "text", max_broadcast_rows=n), lambda n: LX.comparison_scores(posts, subj, cats, "text", carry=["pmi"], max_broadcast_rows=n),
               lambda n: topic_doc_weight(posts.withColumn("tokens", F.split("text", " ")), weights, max_broadcast_rows=n)):
        same(op(0), op(1000))


def test_distinct_tokens_move_not_words(spark, tmp_path, monkeypatch):
    """40 000 words of 100 kinds in one block: 100 rows per task at most meet the table."""
    posts = spark.range(400).select(F.col("id").cast("string").alias("screen_name"), F.lit("t").alias("created_at"),
                                    F.array_join(F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.concat(F.lit("w"), i.cast("string"))), " ").alias("text")).repartition(4)
    lex = spark.range(100).select(F.concat(F.lit("w"), "id").alias("term"), F.lit(1).alias("score"), F.lit("word").alias("kind"))
    seen = {}
    real = B.written
    monkeypatch.setattr(B, "written", lambda df, name: seen.setdefault(name, real(df, name)))
    assert {r["positive"] for r in LX.lexicon_sentiment(posts, lex, max_broadcast_rows=0).collect()} == {100}
    blocks = 8
    assert seen["lookup-terms"].count() <= 100 * 4 * blocks


@pytest.mark.parametrize("block_bytes", [4 << 20, 200])
def test_unique_posts_share_blocks_in_their_order(spark, monkeypatch, block_bytes):
    """Same results as the broadcast join for texts and token arrays, with null and empty ones; a task has as many chunks as its texts fill."""
    monkeypatch.setattr(B, "BLOCK_BYTES", block_bytes)
    posts = posts_of(spark, 7).withColumn("created_at", F.monotonically_increasing_id().cast("string")).localCheckpoint()
    sent = spark.createDataFrame([("good", 3, "word"), ("bad", -3, "word"), (":)", 2, "emoticon"), ("é", None, "word")], "term string, score int, kind string")
    weights = spark.createDataFrame([("good", 0.5), ("bad", None), ("wow", 2.0)], "term string, weight double")
    tokens = posts.withColumn("tokens", F.split("text", " "))
    seen, real = {}, B.written
    monkeypatch.setattr(B, "written", lambda df, name: seen.setdefault(name, real(df, name)) if not seen else real(df, name))
    for op in (lambda n: LX.lexicon_sentiment(posts, sent, max_broadcast_rows=n, unique=True),
               lambda n: topic_doc_weight(tokens, weights, max_broadcast_rows=n, unique=True)):
        same(op(0), op(1000))
    assert list(seen) == ["lookup-terms"]  # the posts are not written, even if they are not landed
    chunks = seen["lookup-terms"].where("_row IS NOT NULL").groupBy("_chunk").agg(F.count(F.lit(1)).alias("n"), F.count("_codes").alias("codes")).collect()
    assert all(c.codes == 1 for c in chunks) and sum(c.n for c in chunks) == 84
    assert len(chunks) == 5 if block_bytes > 200 else len(chunks) > 10


def test_tokens_of_a_task_are_sent_once_whatever_the_blocks(spark, monkeypatch):
    """8 000 posts in a task, with 4 shuffle partitions and texts of 5 blocks: each of 50 words moves once per block, not once per batch and block."""
    monkeypatch.setattr(B, "BLOCK_BYTES", 64_000)
    posts = spark.range(0, 8_000, 1, 1).select(F.col("id").cast("string").alias("screen_name"), F.lit("t").alias("created_at"),
                                               F.array_join(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(F.lit("w"), ((F.col("id") + i) % 50 + 10).cast("string"))), " ").alias("text"))
    lex = spark.range(10, 60).select(F.concat(F.lit("w"), "id").alias("term"), F.lit(1).alias("score"), F.lit("word").alias("kind"))
    seen, real = {}, B.written
    monkeypatch.setattr(B, "written", lambda df, name: seen.setdefault(name, real(df, name)))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        assert {r["positive"] for r in LX.lexicon_sentiment(posts, lex, max_broadcast_rows=0, landed=True, unique=True).collect()} == {10}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    blocks = seen["lookup-terms"].select("_chunk").distinct().count()
    assert blocks == 5 and seen["lookup-terms"].where("_word IS NOT NULL").count() == 50 * blocks


def test_posts_are_parsed_once_for_the_features(spark, sf_small):
    """What the feature queries return reads landed tables: no capture line is parsed again for a second use."""
    plan = P.fixture_five_features(spark, sf_small)._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan and "Generate" not in plan


def plain_clean(text):
    out = []
    for t in text.split():
        if t.lower() in ENGLISH_STOPWORDS:
            continue
        t = t.lower().translate(str.maketrans("", "", string.punctuation))
        if len(t) > 2 and not re.fullmatch(r"\d+", t) and "https" not in t:
            out.append("".join(c for c in t if c.isalnum()))
    return out


def test_clean_tokens_by_brute_force(spark):
    rng = random.Random(5)
    parts = ["The", "it's", "cat,", "12345", "a1b2", "٣٤٥٦", "🎉🎉🎉", "http://t.co/x", "https://a", "ÉTÉ", "x", "--", "ab", "a-b-c", "{{z}}", "w’n", "_under_", "日本語", "1.2.3", "and", "And,"]
    texts = ["", " ", "the and is", "🎉🎉🎉", " cat "] + ["".join(rng.choice(parts) + rng.choice([" ", "\n", "\t ", " ", "　"]) for _ in range(rng.randint(1, 25))) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate([*texts, None])), "i int, text string").select("i", clean_tokens("text").alias("t")).collect()
    assert {r.i: r.t for r in rows} == {i: None if t is None else plain_clean(t) for i, t in enumerate([*texts, None])}


def test_blocks_are_coded_in_little_memory():
    """The numbers of a block's tokens and their bytes' sizes take one to four bytes each on the way, not eight; sums of rows stay exact."""
    numbers = np.array([0, 127, 128, 1 << 21, 5], np.uint32)
    data, size = B.packed(numbers)
    assert size.dtype == np.uint8 and B.unpacked(data)[0].tolist() == numbers.tolist()
    words, lengths = B._cut(pa.array([" a b", None, "", "c　d\n", " "]))
    assert words.to_pylist() == ["a", "b", "c", "d"] and lengths.tolist() == [2, 0, 0, 2, 0]
    words, lengths = B._cut(pa.array([["a", "", None], None, [], ["b"]]))
    assert words.to_pylist() == ["a", "", None, "b"] and lengths.tolist() == [3, 0, 0, 1]
    assert B._between(np.full(600, 200, np.uint8), np.array([0, 300, 0, 300, 0])).tolist() == [0, 60000, 0, 60000, 0]
