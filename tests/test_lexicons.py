"""Lexicons: emoticons and phrases by brute force, one explode, and lexicons beyond the broadcast bound."""

import random
import re

import pytest
from pyspark.sql import functions as F

from postcred.operators import lexicon as LX
from postcred.operators.phrases import TokenTrie, compile_lexicon, phrase_sentiment

WORD = re.compile(r"[\w']+")


def posts_of(seed, n=60):
    rng = random.Random(seed)
    vocab = ["good", "bad", "not", "very", "so", ":)", ":-(", "good/bad", "(good)", "GOOD!", "meh", "é", "<3", "it's", "never", "mind"]
    texts = [None, "", "  \t ", "good " * 500, ":) :) good/bad", "not very good", "never mind"] + [" ".join(rng.choices(vocab, k=rng.randint(1, 30))) for _ in range(n)]
    return [(f"u{i:03d}", "t", t) for i, t in enumerate(texts)]


LEX = [("good", 3, "word"), ("bad", -3, "word"), (":)", 2, "emoticon"), (":-(", -2, "emoticon"), ("<3", 4, "emoticon"), ("it's", 1, "word"), ("zero", 0, "word")]


def frames(spark, seed=1):
    return (spark.createDataFrame(posts_of(seed), "screen_name string, created_at string, text string").repartition(3),
            spark.createDataFrame(LEX, "term string, score int, kind string"))


def plain(text):
    pos = neg = 0
    words, emo = {t: s for t, s, k in LEX if k == "word"}, {t: s for t, s, k in LEX if k == "emoticon"}
    for tok in (text or "").split():
        s = sum(words.get(w, 0) for w in WORD.findall(tok.lower())) + emo.get(tok, 0)
        pos, neg = pos + max(s, 0), neg + min(s, 0)
    return pos, neg, 0


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_sentiment_with_emoticons(spark, bound):
    posts, lex = frames(spark)
    got = {r.screen_name: (r.positive, r.negative, r.neutral) for r in LX.lexicon_sentiment(posts, lex, max_broadcast_rows=bound).collect()}
    assert got == {u: plain(t) for u, _, t in posts_of(1)}


def test_large_lexicons_give_the_same_scores(spark):
    posts, _ = frames(spark, 2)
    posts = posts.withColumnRenamed("text", "text_stripped")
    subj = spark.createDataFrame([("good", 0.5), ("bad", 1.0), ("mind", 0.1)], "term string, subjectivity double")
    cats = spark.createDataFrame([("hate", "bad"), ("money", "good"), ("hate", "good"), ("lust", "never")], "category string, term string")
    for op, lex in ((LX.lexicon_subjectivity, subj), (LX.category_rates, cats)):
        a, b = ({r[0]: tuple(r) for r in op(posts, lex, max_broadcast_rows=n).collect()} for n in (1_000_000, 0))
        assert a.keys() == b.keys() and all(a[k][2:] == pytest.approx(b[k][2:]) for k in a)


def test_filter_keeps_every_entry_and_few_others(spark):
    lex = spark.range(20_000).select(F.concat(F.lit("w"), "id").alias("term"))
    test = LX.lexicon_filter(lex, ["term"])
    rows = spark.range(40_000).select(F.concat(F.lit("w"), "id").alias("term"), (F.col("id") < 20_000).alias("known"))
    n = {r.known: (r.n, r.held) for r in rows.withColumn("held", test).groupBy("known").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("held").cast("int")).alias("held")).collect()}
    assert n[True] == (20_000, 20_000) and n[False][1] < 400


def test_large_lexicon_moves_little(spark):
    """Of 60 000 exploded words a lexicon with 1 % of them moves the hits and a row per post."""
    posts = spark.range(600).select(F.col("id").cast("string").alias("screen_name"), F.lit("t").alias("created_at"),
                                    F.array_join(F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.concat(F.lit("w"), ((F.col("id") * 7 + i) % 1000).cast("string"))), " ").alias("text"))
    lex = spark.range(10).select(F.concat(F.lit("w"), (F.col("id") * 100).cast("string")).alias("term"), F.lit(1).alias("score"), F.lit("word").alias("kind"))
    rows = posts.select("screen_name", "created_at", F.posexplode(F.split("text", " ")).alias("at", "term")).withColumn("kind", F.lit("word"))
    kept = rows.where((F.col("at") == 0) | LX.lexicon_filter(lex, ["kind", "term"])).count()
    assert kept < rows.count() / 10
    small, large = ({tuple(r) for r in LX.lexicon_sentiment(posts, lex, max_broadcast_rows=n).collect()} for n in (100, 0))
    assert small == large and len(small) == 600


def test_one_explode(spark):
    posts, lex = frames(spark)
    plan = LX.lexicon_sentiment(posts, lex)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1


PHRASES = LEX + [("not good", -2, "word"), ("not very good", -1, "word"), ("never mind", 0, "word"), ("Very  Good", 5, "word"), ("", 9, "word"), (None, 1, "word"), ("so", None, "word"),
                 ("good", 9, "word")]


def plain_matches(seq, entries):
    out, at = [], 0
    while at < len(seq):
        fit = [e for e in entries if tuple(seq[at:at + len(e)]) == e]
        if fit:
            best = max(fit, key=len)
            out.append((at, at + len(best), entries[best]))
            at += len(best)
        else:
            at += 1
    return out


def test_trie_is_longest_match():
    rng = random.Random(4)
    for _ in range(200):
        entries = {tuple(rng.choices("abc", k=rng.randint(1, 4))): rng.randint(-5, 5) for _ in range(rng.randint(0, 8))}
        seq = rng.choices("abc", k=rng.randint(0, 15))
        assert TokenTrie(entries.items()).matches(seq) == plain_matches(seq, entries)


def test_phrases_against_plain_matching(spark):
    posts, _ = frames(spark, 3)
    lex = spark.createDataFrame(PHRASES, "term string, score int, kind string")
    words, emo = {}, {}
    for t, s, k in PHRASES:
        if t and s is not None:
            if k == "emoticon":
                emo[t] = s
            else:
                e = tuple(WORD.findall(t.lower()))
                words[e] = min(s, words.get(e, 99))
    got = {r.screen_name: r for r in phrase_sentiment(posts, lex).collect()}
    assert len(got) == len(posts_of(3))
    for u, _, text in posts_of(3):
        seq = []
        for tok in (text or "").split():
            seq += [("\0", tok)] if tok in emo else WORD.findall(tok.lower())
        hits = plain_matches(seq, {**words, **{(("\0", t),): s for t, s in emo.items()}})
        assert (got[u].positive, got[u].negative, got[u].n_phrases) == (
            sum(s for _, _, s in hits if s > 0), sum(s for _, _, s in hits if s < 0), sum(e - a > 1 for a, e, _ in hits))


def test_lexicon_bound(spark):
    lex = spark.createDataFrame(LEX, "term string, score int, kind string")
    with pytest.raises(ValueError):
        compile_lexicon(lex, max_entries=3)
    assert phrase_sentiment(frames(spark)[0].limit(0), lex).collect() == []


def test_phrases_with_a_lexicon_beyond_the_bound(spark, monkeypatch):
    """Matched block by block, each block with its own entries only: the same rows, also for repeated posts and entries that begin alike."""
    from postcred.operators import phrases as PH
    posts, _ = frames(spark, 3)
    posts = posts.unionByName(posts.limit(9))
    more = [("not so good", 7, "word"), ("not so", -4, "word"), ("very so meh", 2, "word"), ("good good good", 1, "word")]
    lex = spark.createDataFrame(PHRASES + more, "term string, score int, kind string")
    want = sorted(tuple(r) for r in phrase_sentiment(posts, lex).collect())
    monkeypatch.setattr(PH, "BLOCK_BYTES", 400)
    monkeypatch.setattr(PH, "WORK_POSTS", 2)
    monkeypatch.setattr(PH, "_trie", None)  # no entry reaches the driver
    got = sorted(tuple(r) for r in phrase_sentiment(posts, lex, max_entries=3).collect())
    assert got == want and len(got) == 76 and any(r[-1] for r in got)
    assert phrase_sentiment(posts.limit(0), lex, max_entries=3).collect() == []
