"""Entry B, scoring of feature tables, the external report and the topic vocabulary."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from postcred.plans import models as M
from postcred.plans import pipeline as P
from postcred.schemas import FEATURES
from postcred.session import checkpoint_dir


def _posts(spark):
    rows = [(f"u{i:02d}", "t", 10 + i, i, f"good words number{i} of a story @someone http://x.y/{i}") for i in range(12)]
    rows += [("gone", "t", 5, 1, "@only http://a.b/c"), ("blank", "t", 5, 1, "")]
    return spark.createDataFrame(rows, "screen_name string, created_at string, followers_count long, retweet_count long, text string")


def test_comparison_features_drop_emptied_posts_and_scale_rows(spark):
    cfg = P.PipelineConfig(topics=2)
    kept = M.comparison_posts(_posts(spark), cfg)
    names = {r["screen_name"] for r in kept.collect()}
    assert names == {f"u{i:02d}" for i in range(12)}
    assert kept.where(F.col("text_stripped").contains("http") | F.col("text_stripped").contains("@")).count() == 0
    weights = spark.createDataFrame([("story", 0.5), ("someon", 9.0), ("someone", 9.0)], "term string, weight double")
    sent = spark.createDataFrame([("good", 2)], "term string, score int").withColumn("kind", F.lit("word"))
    five = M.comparison_five(kept, sent, weights, cfg).collect()
    assert len(five) == 12
    assert all(max(r[c] for c in FEATURES) == pytest.approx(1.0) for r in five)
    plain = P.five_feature_frame(kept, sent, weights, topic_text="text_stripped").collect()
    assert max(r["topic_weight"] for r in plain) < 1  # the mention is not a topic word


def test_feature_table_without_keys_is_scored_like_one_with_keys(spark):
    rows = [(f"p{i:03d}", "t", *[float((i % 3) * 4 + (i * (j + 3)) % 5 * 0.1) for j in range(5)]) for i in range(45)]
    five = spark.createDataFrame(rows, "screen_name string, created_at string, " + ", ".join(f"{c} double" for c in FEATURES))
    cfg = P.PipelineConfig(k=3, algorithm="kmeans", mlp_max_iter=60)
    bundle, _, _ = M.fit_model(spark, P.land(five), cfg)
    keyed = sorted(tuple(r) for r in M.score_features(bundle, five).select(*FEATURES, "label", "predicted").collect())
    bare = sorted(tuple(r) for r in M.score_features(bundle, five.select(*FEATURES)).select(*FEATURES, "label", "predicted").collect())
    assert keyed == bare and len(bare) == 45
    posts = five.select("screen_name", "created_at", F.lit(1).alias("followers_count"), F.lit(2).alias("retweet_count"),
                        F.lit("a\nb").alias("text"))
    report = M.external_report(M.score_features(bundle, five), posts)
    r = report.first()
    equal = sum(a[-1] == a[-2] for a in keyed)
    assert r["text"] == "ab" and r["accuracy_pct"] == pytest.approx(100 * equal / 45) and report.count() == 45


def test_no_local_checkpoint_folder_on_a_cluster():
    sc = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: {}, master="spark://host:7077")
    session = SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d=None: d))
    with pytest.raises(RuntimeError):
        checkpoint_dir(session)
