"""Plan-shape checks: what the physical plans must (not) contain."""

from postcred.operators import text as TX
from postcred.operators.lexicon import lexicon_sentiment
from postcred.plans import pipeline as P


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_dedup_is_the_only_exchange_for_text_stats(spark, sf_small):
    posts = P.posts_from_tables(spark, sf_small)
    d = TX.with_text_stats(TX.with_tokens(posts))
    plan = _plan(d)
    assert plan.count("Exchange") == 1          # the dedup shuffle on the post key
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan   # no Python UDF


def test_token_counts_reuse_key_partitioning(spark, sf_small):
    posts = P.posts_from_tables(spark, sf_small)
    plan = _plan(TX.token_counts(TX.with_tokens(posts)))
    assert plan.count("Exchange") == 1


def test_lexicon_join_is_broadcast_and_co_partitioned(spark, sf_small):
    posts = P.posts_from_tables(spark, sf_small)
    lex = spark.createDataFrame([("cat", 2, "word")], "term string, score int, kind string")
    plan = _plan(lexicon_sentiment(posts, lex))
    assert "BroadcastHashJoin" in plan
    # per-token and per-post sums plus the join back all reuse the dedup partitioning
    assert "SortMergeJoin" not in plan or plan.count("Exchange hashpartitioning(screen_name") <= 2


def test_json_parsed_once_per_line(spark, sf_small):
    from postcred.sources.adapter import capture_lines
    from postcred.sources.captures import filter_originals, parse_posts, project_original
    d = project_original(filter_originals(parse_posts(capture_lines(spark, sf_small))))
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_landed_posts_need_no_exchange_downstream(spark, sf_small):
    from postcred.operators.lexicon import comparison_scores
    posts = P.land_posts(P.posts_from_tables(spark, sf_small))
    lex = spark.createDataFrame([("cat", 2, "word")], "term string, score int, kind string").cache()
    subj = spark.createDataFrame([("cat", 0.5)], "term string, subjectivity double").cache()
    cats = spark.createDataFrame([("money", "cat")], "category string, term string").cache()
    for d in (lex, subj, cats):
        d.count()
    ct = P.comparison_text(posts)
    for df in (TX.token_counts(TX.with_tokens(posts)), lexicon_sentiment(posts, lex),
               comparison_scores(ct, subj, cats)):
        plan = _plan(df)
        assert "Exchange hashpartitioning" not in plan.split("InMemoryRelation")[0], plan
        assert df.count() > 0
