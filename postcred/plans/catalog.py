"""Registered queries: one per operator of the coverage list, each ``(spark, sf_dir) -> DataFrame``.

Deterministic queries have a DuckDB twin in ``oracle_sql()`` (same column names, floats
rounded to 6 digits).  Model fits (LDA, k-means, c-means, NMF, the network) and reports built on
them are registered without SQL: the driver then checks rows only, and ``tests/`` checks their
invariants.  Every query reads the driver's tables and runs over all of their rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postcred.functions.features import DECEPTION_CATEGORIES
from postcred.operators import cluster as CL
from postcred.operators import evaluate as EV
from postcred.operators import features as FE
from postcred.operators import text as TX
from postcred.operators.classify import ordered_split
from postcred.operators.lexicon import category_rates, lexicon_sentiment, lexicon_subjectivity, with_deception_index
from postcred.plans import fixtures as FX
from postcred.plans import oracle as O
from postcred.plans import pipeline as P
from postcred.schemas import FEATURES, KEY
from postcred.sources.adapter import capture_lines, load_table, write_capture_folder
from postcred.sources.captures import (dedup_posts, filter_originals, parse_posts,
                                       project_original, read_captures, union_captures)

K = list(KEY)
POST_COLS = ["screen_name", "created_at", "followers_count", "retweet_count", "text"]


def r6(c) -> F.Column:
    """6-digit rounding with plain IEEE steps, so Spark and DuckDB agree even on exact ties
    (``round`` rounds the decimal text in Spark but the binary value in DuckDB)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c.cast("double") * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6) + F.lit(0.0)


def _r6_all(df: DataFrame, cols) -> DataFrame:
    return df.select(*[r6(c).alias(c) if c in cols else F.col(c) for c in df.columns])


# ---------------------------------------------------------------- S: sources
def q_scan_captures(spark, sf):
    root = write_capture_folder(spark, sf)
    parsed = read_captures(spark, root)
    return project_original(filter_originals(parsed)).select(*POST_COLS)


def q_parse_posts(spark, sf):
    return project_original(filter_originals(parse_posts(capture_lines(spark, sf)))).select(*POST_COLS)


def q_dedup_posts(spark, sf):
    return P.posts_from_tables(spark, sf).select(*POST_COLS)


def q_union_captures(spark, sf):
    root = write_capture_folder(spark, sf)
    a = project_original(filter_originals(read_captures(spark, f"{root}/FlumeData-1")))
    b = project_original(filter_originals(read_captures(spark, f"{root}/FlumeData-2")))
    return dedup_posts(union_captures(a, b)).select(*POST_COLS)


# ---------------------------------------------------------------- T: text
def q_clean_tokens(spark, sf):
    d = TX.with_clean_text(TX.with_tokens(P.posts_from_tables(spark, sf)))
    return d.select(*K, F.size("tokens").cast("long").alias("n_tokens"), "clean_text")


def q_strip_urls(spark, sf):
    from postcred.functions.text import strip_urls
    return P.posts_from_tables(spark, sf).select(*K, strip_urls("text").alias("text_no_urls"))


def q_strip_mentions(spark, sf):
    return TX.with_url_mention_strip(P.posts_from_tables(spark, sf)).select(*K, "text_stripped")


def q_strip_mentions_drop_row(spark, sf):
    return TX.with_url_mention_strip(P.posts_from_tables(spark, sf), policy="drop_row").select(*K, "text_stripped")


def q_drop_empty_posts(spark, sf):
    d = TX.drop_empty_posts(TX.with_url_mention_strip(P.posts_from_tables(spark, sf)))
    return d.select(*K, "text_stripped")


def q_strip_newlines(spark, sf):
    return TX.with_stored_text(P.posts_from_tables(spark, sf)).select(*K, "stored_text")


def q_token_counts(spark, sf):
    return TX.token_counts(TX.with_tokens(P.posts_from_tables(spark, sf)))


def q_bigram_counts(spark, sf):
    ct = P.comparison_text(P.posts_from_tables(spark, sf))
    return TX.bigram_counts(ct, tokens="stokens")


# ---------------------------------------------------------------- L: lexicons
def q_lexicon_sentiment(spark, sf):
    posts = P.landed_posts(spark, sf)
    sent, _, _ = P.fixture_lexicons(posts)
    return lexicon_sentiment(posts, sent, landed=True, unique=True)


def q_lexicon_subjectivity(spark, sf):
    posts = P.landed_posts(spark, sf)
    _, subj, _ = P.fixture_lexicons(posts)
    return _r6_all(lexicon_subjectivity(P.comparison_text(posts), subj), ["subjectivity"])


def q_category_rates(spark, sf):
    posts = P.landed_posts(spark, sf)
    _, _, cats = P.fixture_lexicons(posts)
    return _r6_all(category_rates(P.comparison_text(posts), cats), list(DECEPTION_CATEGORIES))


def q_deception_index(spark, sf):
    posts = P.landed_posts(spark, sf)
    _, _, cats = P.fixture_lexicons(posts)
    d = with_deception_index(category_rates(P.comparison_text(posts), cats))
    return d.select(*K, r6("deception_index").alias("deception_index"))


def q_comparison_scores(spark, sf):
    from postcred.operators.lexicon import comparison_scores
    posts = P.landed_posts(spark, sf)
    _, subj, cats = P.fixture_lexicons(posts)
    d = comparison_scores(P.comparison_text(posts), subj, cats)
    return _r6_all(d, ["subjectivity", "deception_index", *DECEPTION_CATEGORIES])


# ---------------------------------------------------------------- F: features
def q_retweet_ratio(spark, sf):
    return P.with_reach(P.posts_from_tables(spark, sf)).select(*K, r6("nfrq").alias("nfrq"))


def q_token_entropy(spark, sf):
    d = TX.with_text_stats(TX.with_tokens(P.posts_from_tables(spark, sf)), pmi=None)
    return d.select(*K, r6("entropy").alias("entropy"))


def q_pmi_mean(spark, sf):
    d = TX.with_text_stats(P.comparison_text(P.posts_from_tables(spark, sf)), tokens="stokens", entropy=None)
    return d.select(*K, r6("pmi").alias("pmi"))


def q_otc_score(spark, sf):
    posts = P.landed_posts(spark, sf)
    _, subj, cats = P.fixture_lexicons(posts)
    o = P.otc_frame(posts, subj, cats)
    return o.select(*K, *[r6(F.get("otc_parts", i)).alias(n) for i, n in
                          enumerate(["otc_pmi", "otc_objectivity", "otc_truth"])],
                    r6("otc_score").alias("otc_score"))


def q_topic_word_weights(spark, sf):
    posts = P.landed_posts(spark, sf)
    dt, tt = P.fixture_topic_tables(posts, P.stored_tokens(posts))
    from postcred.operators.topics import topic_word_weights
    return topic_word_weights(dt, tt, mode="marginal").select("term", r6(F.col("weight") * 1e6).alias("weight_e6"))


def q_topic_doc_weight(spark, sf):
    return P.fixture_five_features(spark, sf).select(*K, r6("topic_weight").alias("topic_weight"))


def q_five_features(spark, sf):
    return _r6_all(P.fixture_five_features(spark, sf), list(FEATURES))


def q_row_max_normalize(spark, sf):
    return _r6_all(FE.row_max_normalize(P.fixture_five_features(spark, sf)), list(FEATURES))


def q_abs_features(spark, sf):
    return _r6_all(FE.abs_features(P.fixture_five_features(spark, sf)), list(FEATURES))


def _standardized(spark, sf) -> DataFrame:
    return FE.standardize(FE.abs_features(P.fixture_five_features(spark, sf)))


def q_standardize(spark, sf):
    return _r6_all(_standardized(spark, sf), list(FEATURES))


def q_column_sum_normalize(spark, sf):
    return _r6_all(FE.column_sum_normalize(FE.abs_features(P.fixture_five_features(spark, sf))), list(FEATURES))


def q_minmax_int_scale(spark, sf):
    lo, hi = FX.MINMAX_RANGE
    d = FE.minmax_int_scale(P.fixture_five_features(spark, sf), "entropy", lo, hi, out="entropy_scaled")
    return d.select(*K, "entropy_scaled")


def q_read_feature_table(spark, sf):
    from postcred.session import scratch_dir
    from postcred.sources.tables import read_feature_table, write_feature_table
    path = scratch_dir(spark, "features")
    write_feature_table(P.fixture_five_features(spark, sf).select(*K, *FEATURES), path)
    return _r6_all(read_feature_table(spark, path, with_key=True), list(FEATURES))


# ---------------------------------------------------------------- C: clustering with fixed centres
def _fixed_centre_labels(spark, sf) -> DataFrame:
    z = _standardized(spark, sf)
    m = CL.membership_max(CL.fuzzy_memberships(z, FX.FIXED_CENTERS))
    return CL.kmeans_assign(m, FX.FIXED_CENTERS)


def q_fuzzy_memberships(spark, sf):
    d = _fixed_centre_labels(spark, sf)
    k = len(FX.FIXED_CENTERS)
    return d.select(*K, *[r6(F.get("memberships", j)).alias(f"u{j}") for j in range(k)],
                    r6("max_membership").alias("max_membership"), "fuzzy_label", "kmeans_label")


def q_kmeans_assign(spark, sf):
    return _fixed_centre_labels(spark, sf).select(*K, "kmeans_label")


def q_membership_max(spark, sf):
    return _fixed_centre_labels(spark, sf).select(*K, r6("max_membership").alias("max_membership"), "fuzzy_label")


def q_training_labels(spark, sf):
    d = CL.training_labels(_fixed_centre_labels(spark, sf), "fuzzy c-means")
    return d.select(*K, "label")


def q_compare_clusterings(spark, sf):
    return CL.contingency(_fixed_centre_labels(spark, sf))


# ---------------------------------------------------------------- M / E
def q_ordered_split(spark, sf):
    return ordered_split(P.posts_from_tables(spark, sf).select(*K), FX.TEST_SHARE)


def _label_pairs(spark, sf) -> DataFrame:
    return load_table(spark, sf, "labels").select(
        "doc_id", F.col("quality").alias("label"), F.col("toxic").alias("predicted"))


def q_prediction_match(spark, sf):
    return EV.prediction_match(_label_pairs(spark, sf)).select("doc_id", "is_equal")


def q_accuracy(spark, sf):
    return EV.accuracy(_label_pairs(spark, sf)).select(r6("accuracy_pct").alias("accuracy_pct"), "n")


def q_confusion_matrix(spark, sf):
    return EV.confusion_matrix(_label_pairs(spark, sf))


def q_classification_report(spark, sf):
    return _r6_all(EV.classification_report(_label_pairs(spark, sf)), ["precision", "recall", "f1"])


# ---------------------------------------------------------------- registry
def deterministic_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "scan_captures": q_scan_captures,
        "parse_posts": q_parse_posts,
        "dedup_posts": q_dedup_posts,
        "union_captures": q_union_captures,
        "read_feature_table": q_read_feature_table,
        "clean_tokens": q_clean_tokens,
        "strip_urls": q_strip_urls,
        "strip_mentions": q_strip_mentions,
        "strip_mentions_drop_row": q_strip_mentions_drop_row,
        "drop_empty_posts": q_drop_empty_posts,
        "strip_newlines": q_strip_newlines,
        "token_counts": q_token_counts,
        "bigram_counts": q_bigram_counts,
        "lexicon_sentiment": q_lexicon_sentiment,
        "lexicon_subjectivity": q_lexicon_subjectivity,
        "category_rates": q_category_rates,
        "deception_index": q_deception_index,
        "comparison_scores": q_comparison_scores,
        "retweet_ratio": q_retweet_ratio,
        "token_entropy": q_token_entropy,
        "pmi_mean": q_pmi_mean,
        "otc_score": q_otc_score,
        "topic_word_weights": q_topic_word_weights,
        "topic_doc_weight": q_topic_doc_weight,
        "five_features": q_five_features,
        "row_max_normalize": q_row_max_normalize,
        "abs_features": q_abs_features,
        "standardize": q_standardize,
        "column_sum_normalize": q_column_sum_normalize,
        "minmax_int_scale": q_minmax_int_scale,
        "fuzzy_memberships": q_fuzzy_memberships,
        "kmeans_assign": q_kmeans_assign,
        "membership_max": q_membership_max,
        "training_labels": q_training_labels,
        "compare_clusterings": q_compare_clusterings,
        "ordered_split": q_ordered_split,
        "prediction_match": q_prediction_match,
        "accuracy": q_accuracy,
        "confusion_matrix": q_confusion_matrix,
        "classification_report": q_classification_report,
    }


def sql_catalog() -> dict[str, str]:
    K2 = O.K
    posts_cols = f"{K2}, followers_count, retweet_count, text"
    both_obs = f"obs AS ({O.observations_cte(0)} UNION ALL {O.observations_cte(10)})"
    lex = [O.POSTS, O.TOK, O.TERMS]
    strip_ = [O.POSTS, O.STRIPPED]
    feats = list(FEATURES)
    cats = list(DECEPTION_CATEGORIES)
    five_sel = O.select_r6("five", feats)
    z_sel = O.select_r6("zf", feats)
    lo, hi = FX.MINMAX_RANGE
    fixed = O.memberships_sql(FX.FIXED_CENTERS)
    k = len(FX.FIXED_CENTERS)
    u_cols = ", ".join(f"u{j}" for j in range(k))
    otc_parts = ("SELECT *, greatest(pmi, 1 - subjectivity, 1 - deception_index) AS m FROM "
                 "(pmi_t JOIN subj USING (screen_name, created_at) JOIN dec USING (screen_name, created_at))")
    labels = "lab AS (SELECT doc_id, quality AS label, toxic AS predicted FROM labels)"
    cm = ("cmx AS (SELECT a.l AS actual, p.l AS predicted, CAST(count(lab.doc_id) AS BIGINT) AS n FROM "
          "(SELECT DISTINCT l FROM (SELECT label AS l FROM lab UNION ALL SELECT predicted FROM lab)) a, "
          "(SELECT DISTINCT l FROM (SELECT label AS l FROM lab UNION ALL SELECT predicted FROM lab)) p "
          "LEFT JOIN lab ON lab.label = a.l AND lab.predicted = p.l GROUP BY a.l, p.l)")
    per = ("per AS (SELECT actual AS cls, sum(CASE WHEN actual = predicted THEN n ELSE 0 END) AS tp, "
           "sum(n) AS support FROM cmx GROUP BY actual), "
           "pt AS (SELECT predicted AS cls, sum(n) AS pred_n FROM cmx GROUP BY predicted), "
           "cl AS (SELECT CAST(cls AS VARCHAR) AS class, CASE WHEN pred_n = 0 THEN 0.0 ELSE tp / pred_n END AS precision, "
           "CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall, CAST(support AS BIGINT) AS support, tp "
           "FROM per JOIN pt USING (cls)), "
           "cl2 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) "
           "ELSE 0.0 END AS f1 FROM cl), "
           "tot AS (SELECT sum(support) AS total, sum(tp) AS tp, count(*) AS k, sum(precision) AS sp, "
           "sum(recall) AS sr, sum(f1) AS sf, sum(precision * support) AS wp, sum(recall * support) AS wr, "
           "sum(f1 * support) AS wf FROM cl2)")
    report = ("SELECT class, " + O.r6("precision") + " AS precision, " + O.r6("recall") + " AS recall, "
              + O.r6("f1") + " AS f1, support FROM (SELECT class, precision, recall, f1, support FROM cl2 "
              "UNION ALL SELECT 'accuracy', NULL, NULL, tp / total, CAST(total AS BIGINT) FROM tot "
              "UNION ALL SELECT 'macro avg', sp / k, sr / k, sf / k, CAST(total AS BIGINT) FROM tot "
              "UNION ALL SELECT 'weighted avg', wp / total, wr / total, wf / total, CAST(total AS BIGINT) FROM tot)")
    return {
        "scan_captures": O.with_(both_obs) + f"SELECT {posts_cols} FROM obs",
        "parse_posts": O.with_(both_obs) + f"SELECT {posts_cols} FROM obs",
        "dedup_posts": O.with_(O.POSTS) + f"SELECT {posts_cols} FROM posts",
        "union_captures": O.with_(O.POSTS) + f"SELECT {posts_cols} FROM posts",
        "read_feature_table": O.with_(*O.five_ctes()) + five_sel,
        "clean_tokens": O.with_(O.POSTS, O.TOK) + (
            f"SELECT {K2}, CAST(len(tokens) AS BIGINT) AS n_tokens, array_to_string(tokens, ' ') AS clean_text FROM tok"),
        "strip_urls": O.with_(O.POSTS) + f"SELECT {K2}, {O.strip_urls('text')} AS text_no_urls FROM posts",
        "strip_mentions": O.with_(*strip_) + f"SELECT {K2}, text_stripped FROM stripped",
        "strip_mentions_drop_row": O.with_(O.POSTS) + (
            f"SELECT {K2}, {O.strip_mentions('u')} AS text_stripped FROM (SELECT {K2}, {O.strip_urls('text')} AS u "
            f"FROM posts) WHERE len(list_filter({O.split('u')}, lambda w: contains(w, '@') AND w <> '@')) = 0"),
        "drop_empty_posts": O.with_(*strip_) + f"SELECT {K2}, text_stripped FROM kept",
        "strip_newlines": O.with_(O.POSTS) + f"SELECT {K2}, replace(text, chr(10), '') AS stored_text FROM posts",
        "token_counts": O.with_(O.POSTS, O.TOK) + (
            f"SELECT {K2}, term, count(*) AS n FROM (SELECT {K2}, unnest(tokens) AS term FROM tok) GROUP BY ALL"),
        "bigram_counts": O.with_(*strip_, *O.pmi_ctes()[:2]) + (
            f"SELECT {K2}, w1, w2, count(*) AS n FROM pbig GROUP BY ALL"),
        "lexicon_sentiment": O.with_(*lex, O.SENT_LEX, *O.sentiment_ctes()) + (
            f"SELECT {K2}, positive, negative, neutral FROM sentiment"),
        "lexicon_subjectivity": O.with_(*lex, O.SUBJ_LEX, O.STRIPPED, *O.subjectivity_ctes()) + O.select_r6(
            "subj", ["subjectivity"]),
        "category_rates": O.with_(*lex, O.CAT_LEX, O.STRIPPED, *O.category_ctes()) + O.select_r6("cats", cats),
        "deception_index": O.with_(*lex, O.CAT_LEX, O.STRIPPED, *O.category_ctes()) + O.select_r6(
            "dec", ["deception_index"]),
        "comparison_scores": O.with_(*lex, O.SUBJ_LEX, O.CAT_LEX, O.STRIPPED, *O.subjectivity_ctes(),
                                     *O.category_ctes()) + (
            f"SELECT {K2}, {O.r6('subjectivity')} AS subjectivity, "
            + ", ".join(f"{O.r6(c)} AS {c}" for c in cats)
            + f", {O.r6('deception_index')} AS deception_index FROM subj JOIN cats USING ({K2}) JOIN dec USING ({K2})"),
        "retweet_ratio": O.with_(O.POSTS) + f"SELECT {K2}, {O.r6(O.NFRQ)} AS nfrq FROM posts",
        "token_entropy": O.with_(O.POSTS, O.TOK, *O.entropy_ctes()) + O.select_r6("entropy_t", ["entropy"]),
        "pmi_mean": O.with_(*strip_, *O.pmi_ctes()) + O.select_r6("pmi_t", ["pmi"]),
        "otc_score": O.with_(*lex, O.SUBJ_LEX, O.CAT_LEX, O.STRIPPED, *O.pmi_ctes(), *O.subjectivity_ctes(),
                             *O.category_ctes()) + (
            f"SELECT {K2}, {O.r6('CASE WHEN m <> 0 THEN pmi / m END')} AS otc_pmi, "
            f"{O.r6('CASE WHEN m <> 0 THEN (1 - subjectivity) / m END')} AS otc_objectivity, "
            f"{O.r6('CASE WHEN m <> 0 THEN (1 - deception_index) / m END')} AS otc_truth, "
            f"{O.r6('CASE WHEN m <> 0 THEN abs((pmi / m + (1 - subjectivity) / m + (1 - deception_index) / m) / 3) ELSE 0.0 END')}"
            f" AS otc_score FROM ({otc_parts})"),
        "topic_word_weights": O.with_(O.POSTS, O.STORED, *O.topic_ctes()) + (
            f"SELECT term, {O.r6('weight * 1e6')} AS weight_e6 FROM wweight"),
        "topic_doc_weight": O.with_(*O.five_ctes()) + O.select_r6("five", ["topic_weight"]),
        "five_features": O.with_(*O.five_ctes()) + five_sel,
        "row_max_normalize": O.with_(*O.five_ctes(), "rm AS (SELECT *, greatest(nfrq, positive, negative, entropy, "
                                     "topic_weight) AS mx FROM five)") + (
            f"SELECT {K2}, " + ", ".join(f"{O.r6(f'CASE WHEN mx <> 0 THEN {c} / mx ELSE 0.0 END')} AS {c}"
                                         for c in feats) + " FROM rm"),
        "abs_features": O.with_(*O.five_ctes()) + (
            f"SELECT {K2}, " + ", ".join(f"{O.r6(f'abs({c})')} AS {c}" for c in feats) + " FROM five"),
        "standardize": O.with_(*O.standardized_ctes()) + z_sel,
        "column_sum_normalize": O.with_(*O.standardized_ctes()[:-1], "csum AS (SELECT " + ", ".join(
            f"sum({c}) AS t_{c}" for c in feats) + " FROM absf)") + (
            f"SELECT {K2}, " + ", ".join(f"{O.r6(f'CASE WHEN t_{c} = 0 THEN NULL ELSE {c} / t_{c} END')} AS {c}"
                                         for c in feats) + " FROM absf, csum"),
        "minmax_int_scale": O.with_(*O.five_ctes(), "mm AS (SELECT min(entropy) AS lo, max(entropy) AS hi FROM five)") + (
            f"SELECT {K2}, CASE WHEN hi - lo <> 0 THEN CAST(trunc((entropy - lo) * ({float(hi - lo)} / (hi - lo)) "
            f"+ {float(lo)}) AS BIGINT) ELSE CAST(0 AS BIGINT) END AS entropy_scaled FROM five, mm"),
        "fuzzy_memberships": O.with_(*O.standardized_ctes()) + fixed,
        "kmeans_assign": O.with_(*O.standardized_ctes()) + f"SELECT {K2}, kmeans_label FROM ({fixed})",
        "membership_max": O.with_(*O.standardized_ctes()) + f"SELECT {K2}, max_membership, fuzzy_label FROM ({fixed})",
        "training_labels": O.with_(*O.standardized_ctes()) + f"SELECT {K2}, fuzzy_label AS label FROM ({fixed})",
        "compare_clusterings": O.with_(*O.standardized_ctes()) + (
            f"SELECT kmeans_label, fuzzy_label, count(*) AS n FROM ({fixed}) GROUP BY ALL"),
        "ordered_split": O.with_(O.POSTS, f"ix AS (SELECT {K2}, row_number() OVER (ORDER BY screen_name, created_at) - 1"
                                          " AS row_index, count(*) OVER () AS n FROM posts)") + (
            f"SELECT {K2}, CAST(row_index AS BIGINT) AS row_index, CASE WHEN row_index < n - CAST(ceil(n * "
            f"{FX.TEST_SHARE}) AS BIGINT) THEN 'train' ELSE 'test' END AS split FROM ix"),
        "prediction_match": "SELECT doc_id, quality = toxic AS is_equal FROM labels",
        "accuracy": (f"SELECT {O.r6('avg(CAST(quality = toxic AS DOUBLE)) * 100.0')} AS accuracy_pct, "
                     "count(*) AS n FROM labels"),
        "confusion_matrix": O.with_(labels, cm) + "SELECT actual, predicted, n FROM cmx",
        "classification_report": O.with_(labels, cm, per) + report,
    }
