"""Numeric golden rows (FIXTURES.md §4) for feature, lexicon, clustering and split operators."""

import pytest
from pyspark.sql import functions as F

from postcred.functions.features import deception_index, otc_parts, otc_score, retweet_ratio
from postcred.operators import cluster as CL
from postcred.operators import features as FE
from postcred.operators.classify import ordered_split
from postcred.operators.lexicon import category_rates, lexicon_sentiment, lexicon_subjectivity

COLS = ["nfrq", "positive", "negative", "entropy", "topic_weight"]


def test_retweet_ratio(spark):
    df = spark.createDataFrame([(10, 5), (10, 50), (0, 9)], "rt long, fo long")
    assert [r[0] for r in df.select(retweet_ratio("rt", "fo")).collect()] == [0.5, 0.0, 0.0]


def test_otc(spark):
    df = spark.createDataFrame([(2.0, 0.4, 0.1), (0.0, 1.0, 1.0)], "pmi double, subj double, dec double")
    d = df.select(otc_parts("pmi", "subj", "dec").alias("p")).select("p", otc_score("p").alias("s")).collect()
    assert d[0]["p"] == pytest.approx([1.0, 0.3, 0.45])
    assert d[0]["s"] == pytest.approx(0.583333, abs=1e-6)
    assert d[1]["p"] == [] and d[1]["s"] == 0.0


def test_row_max_normalize(spark):
    df = spark.createDataFrame([(0.0, 4.0, -2.0, 2.0, 1.0), (0.0, 0.0, 0.0, 0.0, 0.0)], ", ".join(f"{c} double" for c in COLS))
    rows = [tuple(r) for r in FE.row_max_normalize(df).collect()]
    assert rows[0] == pytest.approx((0.0, 1.0, -0.5, 0.5, 0.25))
    assert rows[1] == (0.0,) * 5


def test_standardize_population_std(spark):
    df = spark.createDataFrame([(1.0, 7.0), (2.0, 7.0), (4.0, 7.0)], "a double, b double")
    z = FE.standardize_apply(df, FE.standardize_fit(df, ["a", "b"])).collect()
    assert [r["a"] for r in z] == pytest.approx([-1.069045, -0.267261, 1.336306], abs=1e-6)
    assert [r["b"] for r in z] == [0.0, 0.0, 0.0]
    z2 = FE.standardize(df, ["a", "b"]).collect()
    assert [r["a"] for r in z2] == pytest.approx([-1.069045, -0.267261, 1.336306], abs=1e-6)


def test_column_sum_and_minmax(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (2.0,)], "a double")
    assert [r[0] for r in FE.column_sum_normalize(df, ["a"]).collect()] == pytest.approx([0.25, 0.25, 0.5])
    df2 = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "a double")
    assert [r[0] for r in FE.minmax_int_scale(df2, "a", 0, 10).collect()] == [0, 3, 10]
    df3 = spark.createDataFrame([(5.0,), (5.0,)], "a double")
    assert [r[0] for r in FE.minmax_int_scale(df3, "a", 0, 10).collect()] == [0, 0]


def test_fuzzy_memberships_golden(spark):
    df = spark.createDataFrame([(1.0,)], "x double")
    m = CL.membership_max(CL.fuzzy_memberships(df, [[0.0], [3.0]], cols=["x"])).first()
    assert m["memberships"] == pytest.approx([0.8, 0.2])
    assert m["fuzzy_label"] == 0 and m["max_membership"] == pytest.approx(0.8)


def test_memberships_sum_to_one_and_on_centre(spark):
    df = spark.range(50).select((F.col("id") / 7.0).alias("x"), (F.col("id") % 5).cast("double").alias("y"))
    cs = [[0.0, 0.0], [3.0, 4.0], [1.0, 1.0]]
    rows = CL.fuzzy_memberships(df, cs, cols=["x", "y"]).collect()
    for r in rows:
        assert sum(r["memberships"]) == pytest.approx(1.0)
    on = spark.createDataFrame([(0.0, 0.0)], "x double, y double")
    u = CL.fuzzy_memberships(on, cs, cols=["x", "y"]).first()["memberships"]
    assert u[0] == pytest.approx(1.0)


def test_deception_index(spark):
    cats = ["deception", "money", "hate", "envy", "crime", "magic", "fear", "lust", "power"]
    vals = [0.1, 0, 0, 0, 0, 0, 0, 0, 0.8]
    df = spark.createDataFrame([tuple(float(v) for v in vals)], ", ".join(f"{c} double" for c in cats))
    assert df.select(deception_index()).first()[0] == pytest.approx(0.2)
    df2 = spark.createDataFrame([(0.3, None)], "deception double, money double")
    d2 = df2.select(*[F.lit(0.0).alias(c) if c not in ("deception", "money") else F.col(c) for c in cats])
    assert d2.select(deception_index()).first()[0] == pytest.approx(0.3)


def test_ordered_split(spark):
    df = spark.createDataFrame([(f"u{i:02d}", "t") for i in range(10)], "screen_name string, created_at string")
    s = {r["screen_name"]: (r["row_index"], r["split"]) for r in ordered_split(df, 0.23).collect()}
    assert sorted(v[0] for v in s.values()) == list(range(10))
    assert [k for k, v in sorted(s.items()) if v[1] == "test"] == ["u07", "u08", "u09"]
    with pytest.raises(ValueError):
        ordered_split(df, 0.4)


def test_lexicon_joins(spark):
    posts = spark.createDataFrame([("a", "t", "good/bad great :) meh", "great thing"), ("b", "t", "nothing", "")],
                                  "screen_name string, created_at string, text string, text_stripped string")
    lex = spark.createDataFrame([("good", 3, "word"), ("bad", -3, "word"), ("great", 3, "word"),
                                 ("meh", -2, "word"), (":)", 2, "emoticon")], "term string, score int, kind string")
    s = {r["screen_name"]: r for r in lexicon_sentiment(posts, lex).collect()}
    assert (s["a"]["positive"], s["a"]["negative"], s["a"]["neutral"]) == (5, -2, 0)
    assert (s["b"]["positive"], s["b"]["negative"]) == (0, 0)
    subj = spark.createDataFrame([("great", 0.75), ("thing", 0.25)], "term string, subjectivity double")
    v = {r["screen_name"]: r["subjectivity"] for r in lexicon_subjectivity(posts, subj).collect()}
    assert v == {"a": 0.5, "b": 0.0}
    catlex = spark.createDataFrame([("money", "great"), ("power", "great"), ("fear", "thing")], "category string, term string")
    c = {r["screen_name"]: r for r in category_rates(posts, catlex).collect()}
    assert (c["a"]["money"], c["a"]["power"], c["a"]["fear"], c["a"]["hate"]) == (0.5, 0.5, 0.5, 0.0)
    assert c["b"]["money"] == 0.0


def test_comparison_scores_equals_separate_operators(spark, sf_small):
    from postcred.operators.lexicon import comparison_scores, with_deception_index
    from postcred.plans import pipeline as P
    posts = P.posts_from_tables(spark, sf_small)
    _, subj, cats = P.fixture_lexicons(posts)
    ct = P.comparison_text(posts)
    one = {(r["screen_name"], r["created_at"]): r for r in comparison_scores(ct, subj, cats).collect()}
    s = {(r["screen_name"], r["created_at"]): r["subjectivity"] for r in lexicon_subjectivity(ct, subj).collect()}
    c = {(r["screen_name"], r["created_at"]): r for r in with_deception_index(category_rates(ct, cats)).collect()}
    assert set(one) == set(s) == set(c) and len(one) > 0
    for k, r in one.items():
        assert r["subjectivity"] == pytest.approx(s[k], abs=1e-12)
        assert r["deception_index"] == pytest.approx(c[k]["deception_index"], abs=1e-12)
        assert r["money"] == pytest.approx(c[k]["money"], abs=1e-12)
