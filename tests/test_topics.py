"""Topic fit on a sharded word table against the plain algorithm; likelihood, chunks, saved models, odd rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postcred.operators import topics as TP


def digamma(x):
    """Derivative of log gamma by its recurrence to 40 and a short series."""
    out = 0.0
    while x < 40:
        out -= 1 / x
        x += 1
    return out + math.log(x) - 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x ** 4)


def texts(seed, n=40, k=3):
    rng = random.Random(seed)
    words = [[f"t{t}w{i}" for i in range(6)] for t in range(k)]
    return [[rng.choice(words[d % k] if rng.random() < 0.9 else words[rng.randrange(k)]) for _ in range(rng.randint(1, 25))] for d in range(n)]


def frame(spark, docs, parts=3):
    return spark.createDataFrame([(f"u{i:03d}", "t", d) for i, d in enumerate(docs)], "screen_name string, created_at string, tokens array<string>").repartition(parts)


def plain_pass(docs, lam, k, alpha, eta):
    """One pass of batch variational Bayes over {term: counts}, in plain Python."""
    total = [sum(v[t] for v in lam.values()) for t in range(k)]
    beta = {w: [math.exp(digamma(v[t]) - digamma(total[t])) for t in range(k)] for w, v in lam.items()}
    new = {w: [eta] * k for w in lam}
    mixes = []
    for doc in docs:
        bag = {w: doc.count(w) for w in set(doc) if w in lam}
        gamma = [1.0] * k
        for _ in range(TP.INNER_STEPS):
            theta = [math.exp(digamma(g) - digamma(sum(gamma))) for g in gamma]
            norm = {w: sum(theta[t] * beta[w][t] for t in range(k)) + 1e-100 for w in bag}
            fresh = [alpha + theta[t] * sum(n / norm[w] * beta[w][t] for w, n in bag.items()) for t in range(k)]
            moved = sum(abs(a - b) for a, b in zip(fresh, gamma)) / k
            gamma = fresh
            if moved < TP.INNER_TOLERANCE:
                break
        theta = [math.exp(digamma(g) - digamma(sum(gamma))) for g in gamma]
        for w, n in bag.items():
            norm = sum(theta[t] * beta[w][t] for t in range(k)) + 1e-100
            for t in range(k):
                new[w][t] += n / norm * theta[t] * beta[w][t]
        mixes.append([g / sum(gamma) for g in gamma] if bag else [1 / k] * k)
    return new, mixes


def table(model):
    return {r.term: list(r.lam) for r in model.words.collect()}


def test_digamma():
    for x in (1e-3, 0.02, 0.5, 1.0, 1.4616, 3.3, 6.0, 17.0, 1e6):
        assert TP.digamma(np.array([x]))[0] == pytest.approx(digamma(x), rel=1e-10, abs=1e-10)


@pytest.mark.parametrize("block, work", [(200_000, 20_000), (60, 7)])
def test_one_pass_equals_the_plain_algorithm(spark, monkeypatch, block, work):
    """Also with many blocks and many small ranges of posts: each post counts once and stops by itself."""
    monkeypatch.setattr(TP, "BLOCK_PAIRS", block)
    docs = texts(1) + [[], ["t0w0"] * 30]
    df = frame(spark, docs)
    start = {r.term: list(r.lam) for r in df.select(F.explode("tokens").alias("term")).distinct().select("term", TP.start_counts(F.col("term"), 3, 7).alias("lam")).collect()}
    assert all(0.5 < v < 1.5 for row in start.values() for v in row) and len({tuple(v) for v in start.values()}) == len(start)
    model = TP.fit_topics(df, k=3, passes=1, seed=7)
    want, _ = plain_pass(docs, start, 3, 1 / 3, 1 / 3)
    got = table(model)
    assert got.keys() == want.keys()
    assert np.abs(np.array([got[w] for w in want]) - np.array(list(want.values()))).max() < 1e-8
    assert sum(model.totals) == pytest.approx(sum(map(len, docs)) + len(want), rel=1e-9)  # every token once, and the prior
    _, mixes = plain_pass(docs, got, 3, 1 / 3, 1 / 3)
    mix = {r.screen_name: list(r.theta) for r in TP.topic_mixtures(model, df).collect()}
    assert np.abs(np.array([mix[f"u{i:03d}"] for i in range(len(docs))]) - np.array(mixes)).max() < 1e-8


def test_likelihood_rises_and_topics_are_found(spark):
    docs = texts(2, 60, 2)
    model = TP.fit_topics(frame(spark, docs), k=2, passes=15, seed=3)
    assert all(b >= a - 1e-9 for a, b in zip(model.bounds, model.bounds[1:])) and model.bounds[-1] > model.bounds[0] + 0.3
    top = {}
    for w, lam in table(model).items():
        top.setdefault(int(np.argmax(lam)), set()).add(w[:2])
    assert sorted(tuple(v) for v in top.values()) == [("t0",), ("t1",)]


def test_chunks_see_every_post_once(spark):
    docs = texts(4, 50)
    model = TP.fit_topics(frame(spark, docs), k=2, passes=2, chunk_size=13)
    assert len(model.bounds) == 2 and model.bounds[1] > model.bounds[0]
    one = TP.fit_topics(frame(spark, docs), k=2, passes=1, chunk_size=13)
    assert set(table(one)) == {w for d in docs for w in d}


def test_word_weights_and_positional_mode(spark):
    docs = texts(5)
    df = frame(spark, docs)
    model = TP.fit_topics(df, k=3)
    theta = TP.topic_mixtures(model, df)
    dt = TP.topic_distribution(model, df)
    fast = {r.term: r.weight for r in TP.model_word_weights(model, theta=theta).collect()}
    slow = {r.term: r.weight for r in TP.topic_word_weights(dt, TP.model_topic_terms(model)).collect()}
    assert fast.keys() == slow.keys() and all(fast[w] == pytest.approx(slow[w], rel=1e-9) for w in fast) and sum(fast.values()) == pytest.approx(1.0)
    words = sorted({w for d in docs for w in d}, key=lambda w: (-sum(d.count(w) for d in docs), w))[:3]
    last = {r.topic_id: r.prob for r in dt.where("screen_name = 'u039'").collect()}
    got = {r.term: r.weight for r in TP.model_word_weights(model, doc_topics=dt, mode="positional").collect()}
    assert got == {w: pytest.approx(last[i]) for i, w in enumerate(words)}


def test_vocabulary_bounds_and_empty_corpus(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a", "d"],), ([],), (None,)], "tokens array<string>")
    assert set(table(TP.fit_topics(df, k=2))) == {"a", "b", "c", "d"}
    assert set(table(TP.fit_topics(df, k=2, vocab_size=2))) == {"a", "b"}
    assert set(table(TP.fit_topics(df, k=2, min_df=2))) == {"a"}
    empty = TP.fit_topics(df.limit(0), k=2)
    assert empty.words.count() == 0 and empty.totals == [0.0, 0.0]


def test_saved_model(spark, tmp_path):
    df = frame(spark, texts(6))
    model = TP.fit_topics(df, k=2)
    model.save(f"{tmp_path}/m")
    back = TP.TopicModel.load(spark, f"{tmp_path}/m")
    assert table(back) == table(model) and (back.totals, back.k, back.alpha) == (model.totals, 2, 0.5)
    a = {r.screen_name: list(r.theta) for r in TP.topic_mixtures(model, df).collect()}
    assert a == {r.screen_name: pytest.approx(list(r.theta)) for r in TP.topic_mixtures(back, df).collect()}


def test_no_vocabulary_in_the_driver(spark):
    """300 000 terms: the driver holds a total per topic, whatever the vocabulary."""
    rows = spark.range(3000).select(F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.concat(F.lit("w"), (F.col("id") * 100 + i).cast("string"))).alias("tokens"))
    model = TP.fit_topics(rows, k=4, chunk_size=2000)
    assert model.words.count() == 300_000 and len(model.totals) == 4


def test_rows_sent_on_give_the_whole_table_of_plain_chunks(spark):
    """Chunks that hold different terms: rows are read where their terms are, and equal the algorithm that blends the whole table each step."""
    docs = texts(11, 30) + [["only", "once"], [], ["t0w0", "rare"]]
    df = frame(spark, docs)
    k, passes, size = 3, 2, 7
    model = TP.fit_topics(df, k=k, passes=passes, chunk_size=size, seed=5)
    chunks = math.ceil(len(docs) / size)
    numbered = df.select(F.monotonically_increasing_id().alias("post"), F.col("tokens").alias("toks"))
    dealt = {}
    for r in TP._bags(numbered, None, chunks).collect():
        dealt.setdefault(r.block % chunks, {}).setdefault(r.post, []).extend([r.term] * int(r.n))
    names = sorted({w for d in docs for w in d})
    lam = {r.term: list(r.lam) for r in spark.createDataFrame([(w,) for w in names], "term string").select("term", TP.start_counts(F.col("term"), k, 5).alias("lam")).collect()}
    step = 0
    for _ in range(passes):
        for c in range(chunks):
            new, _ = plain_pass(list(dealt.get(c, {}).values()), lam, k, 1 / k, 0.0)
            rho = (1 + step) ** -0.5
            lam = {w: [(1 - rho) * a + rho * (1 / k + chunks * b) for a, b in zip(lam[w], new[w])] for w in lam}
            step += 1
    got = table(model)
    assert got.keys() == lam.keys()
    for w in lam:
        assert got[w] == pytest.approx(lam[w], rel=1e-6)
    assert model.totals == pytest.approx([sum(v[t] for v in lam.values()) for t in range(k)], rel=1e-6)


def test_mixtures_of_the_fit_are_made_from_its_own_bags(spark, monkeypatch):
    """Several blocks a chunk, more than a word of bits: the same mixtures as of the posts given again, tokens counted once only."""
    monkeypatch.setattr(TP, "BLOCK_PAIRS", 8)
    docs = texts(9, 45) + [[], ["rare", "t0w0"]]
    df = frame(spark, docs, 1)
    model = TP.fit_topics(df, k=3, chunk_size=30, key=TP.KEY)
    again = {r.screen_name: list(r.theta) for r in TP.topic_mixtures(model, df).collect()}
    monkeypatch.setattr(TP, "_bags", None)
    got = {r.screen_name: list(r.theta) for r in TP.topic_mixtures(model).collect()}
    assert len(got) == 47 and got == {u: pytest.approx(t, abs=1e-9) for u, t in again.items()}
    assert sum(r.prob for r in TP.topic_distribution(model).collect()) == pytest.approx(47)
    assert max(r.block for r in model.seen[1].collect()) >= 64
