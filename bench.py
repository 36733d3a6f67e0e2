"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints ONE JSON line.

Each query is forced with the ``noop`` sink (full execution, nothing collected) and timed after
one warm-up run of the shared input scan.  Set BENCH_SKIP_MODEL=1 to leave out the model fit.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from postcred.operators import text as TX  # noqa: E402
from postcred.operators.lexicon import comparison_scores, lexicon_sentiment  # noqa: E402
from postcred.plans import pipeline as P  # noqa: E402
from postcred.session import build_session  # noqa: E402


def run(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", app_name="postcred-bench", shuffle_partitions=int(cpus) * 2)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None

    landed = {}

    def q_ingest():
        landed["posts"] = P.land_posts(P.posts_from_tables(spark, sf_dir))

    def q_text_stats():
        d = TX.with_text_stats(TX.with_tokens(P.with_reach(posts)), pmi=None)
        ct = TX.with_text_stats(P.comparison_text(posts), tokens="stokens", entropy=None)
        run(d.select("screen_name", "created_at", "nfrq", "entropy").join(
            ct.select("screen_name", "created_at", "pmi"), ["screen_name", "created_at"], "left"))

    def q_token_counts():
        run(TX.token_counts(TX.with_tokens(posts)))

    def q_lexicons():
        ct = P.comparison_text(posts)
        run(lexicon_sentiment(posts, sent).join(comparison_scores(ct, subj, cats), ["screen_name", "created_at"], "left"))

    def q_five_features():
        ltok = P.stored_tokens(posts)
        dt, tt = P.fixture_topic_tables(posts, ltok)
        from postcred.operators.topics import topic_word_weights
        run(P.five_feature_frame(posts, sent, topic_word_weights(dt, tt, mode="marginal")))

    def q_otc():
        run(P.otc_frame(posts, subj, cats))

    def q_model_pipeline():
        from postcred.plans.models import fit_model, model_features
        cfg = P.PipelineConfig(k=3, algorithm="fuzzy c-means", compare_both=True, topics=20,
                               mlp_max_iter=100, cmeans_max_iter=100)
        five, art = model_features(spark, posts, sent, cfg)
        _, labelled, pred = fit_model(spark, five, cfg, art.weights)
        run(pred)

    queries = {
        "text_stats": q_text_stats,
        "token_counts": q_token_counts,
        "lexicon_scores": q_lexicons,
        "five_features": q_five_features,
        "otc_score": q_otc,
    }
    if os.environ.get("BENCH_SKIP_MODEL") != "1":
        queries["model_pipeline"] = q_model_pipeline

    run(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.length("text")))  # warm the scan / JIT
    times = {}
    t0 = time.time()
    q_ingest()
    times["ingest_dedup"] = round(time.time() - t0, 3)
    posts = landed["posts"]
    t0 = time.time()
    sent, subj, cats = [d.cache() for d in P.fixture_lexicons(posts)]
    run(sent)
    times["fixture_lexicons"] = round(time.time() - t0, 3)
    for name, fn in queries.items():
        t0 = time.time()
        fn()
        times[name] = round(time.time() - t0, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
