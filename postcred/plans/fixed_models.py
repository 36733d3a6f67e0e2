"""Model steps with given parameters, each with its DuckDB twin.

Fits are not reproducible in SQL, but every step of them is once its parameters are given: one c-means and one factorisation step, the
network's scores, the reports, and the scoring of other posts.  Centres, basis and network weights are fixed values or follow a rule
(``fixtures``); scaler statistics are fitted on ``documents``, and the posts scored as external are the turns of ``conversations``.
"""

from __future__ import annotations

import re
from itertools import permutations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postcred.operators import classify as MC
from postcred.operators import cluster as CL
from postcred.operators import features as FE
from postcred.operators import text as TX
from postcred.operators.factorize import nmf_step
from postcred.operators.lexicon import lexicon_sentiment
from postcred.operators.phrases import phrase_sentiment
from postcred.plans import fixtures as FX
from postcred.plans import models as M
from postcred.plans import oracle as O
from postcred.plans import pipeline as P
from postcred.functions.text import split_ws
from postcred.operators.lexicon import EMOTICON_SIGN
from postcred.schemas import FEATURES, KEY
from postcred.session import scratch_dir
from postcred.sources.adapter import capture_lines, conversation_lines
from postcred.sources.captures import counted_posts, ingest_counts, read_posts
from postcred.sources.lexicons import FIXTURE_SCORE_SQL
from postcred.sources.store import PostStore
from postcred.sources.tables import read_report, write_report

K = list(KEY)
CFG = P.PipelineConfig(k=len(FX.FIXED_CENTERS), algorithm="kmeans", compare_both=True)


def r6(c):
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c.cast("double") * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6) + F.lit(0.0)


def _rounded(df: DataFrame, cols) -> DataFrame:
    return df.select(*[r6(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def fixed_network() -> MC.Network:
    """A network whose weights follow a rule."""
    layers = [len(FEATURES)] * 4 + [CFG.k]
    weights = [np.array([[FX.net_weight(n, i, j) for j in range(b)] for i in range(a)]) for n, (a, b) in enumerate(zip(layers, layers[1:]))]
    biases = [np.array([FX.net_bias(n, j) for j in range(b)]) for n, b in enumerate(layers[1:])]
    return MC.Network(layers, weights, biases)


def _fitted(spark, sf):
    """(posts, five features, scaler statistics, standardised features, sentiment lexicon, topic weights) of ``documents``; posts landed once."""
    posts, five, sent, weights = P.fixture_fit(spark, sf)
    stats = FE.standardize_fit(FE.abs_features(five))
    return posts, five, stats, FE.standardize_apply(FE.abs_features(five), stats), sent, weights


def _labelled(z: DataFrame) -> DataFrame:
    return M.label_posts(z, CFG, FX.FIXED_CENTERS, FX.FIXED_CENTERS)


def _bundle(stats, weights) -> M.ModelBundle:
    return M.ModelBundle(CFG, stats, None, [list(c) for c in FX.FIXED_CENTERS], [list(c) for c in FX.FIXED_CENTERS], fixed_network(), weights)


# ------------------------------------------------------------------------------------------ queries
def q_ingest_counts(spark, sf):
    posts, of_lines, of_posts = counted_posts(capture_lines(spark, sf))
    P.land(posts)  # the one action: the counts come from its scan
    return ingest_counts(of_lines, of_posts, spark, CFG.k, FX.TEST_SHARE)


def q_merge_posts(spark, sf):
    """First captures landed in buckets, the later ones merged into them."""
    from postcred.sources.adapter import write_capture_folder
    from postcred.sources.captures import filter_originals, project_original, read_captures
    root = write_capture_folder(spark, sf)
    first, later = (project_original(filter_originals(read_captures(spark, f"{root}/FlumeData-{i}"))) for i in (1, 2))
    store = PostStore(spark, scratch_dir(spark, "post-store"))
    size = first.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    store.create(first, size, bucket_bytes=1 << 20)
    store.merge(later)
    return store.read().select(*K, "followers_count", "retweet_count", "text")


def q_lexicon_emoticons(spark, sf):
    """Word valences plus valences of raw tokens with a sign in them."""
    posts = P.landed_posts(spark, sf)
    sent, _, _ = P.fixture_lexicons(posts)
    signs = posts.select(F.explode(split_ws("text")).alias("term")).where(F.col("term").rlike(EMOTICON_SIGN)).distinct()
    signs = signs.select("term", F.expr(FIXTURE_SCORE_SQL).cast("int").alias("score")).where("score <> 0").withColumn("kind", F.lit("emoticon"))
    return lexicon_sentiment(posts, sent.unionByName(signs), landed=True, unique=True)


def q_lexicon_large(spark, sf):
    """The sentiment scores with a lexicon that is treated as beyond the broadcast bound."""
    posts = P.landed_posts(spark, sf)
    sent, _, _ = P.fixture_lexicons(posts)
    return lexicon_sentiment(posts, sent, max_broadcast_rows=0, landed=True, unique=True)


def q_phrase_sentiment(spark, sf):
    """Words, and as phrases the bigrams that the posts hold 20 times or more."""
    posts = P.landed_posts(spark, sf)
    sent, _, _ = P.fixture_lexicons(posts)
    pairs = TX.bigram_counts(P.comparison_text(posts), tokens="stokens").groupBy("w1", "w2").agg(F.sum("n").alias("n")).where("n >= 20")
    phrases = pairs.select(F.concat_ws(" ", "w1", "w2").alias("term")).select("term", F.expr(FIXTURE_SCORE_SQL).cast("int").alias("score"), F.lit("word").alias("kind"))
    return phrase_sentiment(posts, sent.unionByName(phrases))


def q_cmeans_step(spark, sf):
    _, _, _, z, _, _ = _fitted(spark, sf)
    centers = CL.cmeans_step(z, FX.FIXED_CENTERS)
    return _rounded(spark.createDataFrame([(i, *c) for i, c in enumerate(centers)], "label int, " + ", ".join(f"{c} double" for c in FEATURES)), FEATURES)


def q_nmf_step(spark, sf):
    _, five, _, _, _, _ = _fitted(spark, sf)
    basis = np.array([[FX.basis_value(j, i) for i in range(len(FEATURES))] for j in range(FX.BASIS_RANK)])
    new, _ = nmf_step(FE.abs_features(five), FEATURES, basis, FX.BASIS_START, FX.BASIS_STEPS)
    return _rounded(spark.createDataFrame([(j, *map(float, r)) for j, r in enumerate(new)], "component int, " + ", ".join(f"{c} double" for c in FEATURES)), FEATURES)


def q_match_clusterings(spark, sf):
    _, _, _, z, _, _ = _fitted(spark, sf)
    d = CL.kmeans_assign(CL.kmeans_assign(z, FX.FIXED_CENTERS, out="kmeans_label"), FX.OTHER_CENTERS, out="fuzzy_label")
    m = CL.match_clusterings(d)
    rows = [(int(a), None if b is None else int(b), m.agreeing, m.total, m.rand_index) for a, b in sorted(m.pairs.items())]
    return _rounded(spark.createDataFrame(rows, "kmeans_label int, matched_label int, agreeing long, total long, rand_index double"), ["rand_index"])


def q_network_scores(spark, sf):
    _, _, _, z, _, _ = _fitted(spark, sf)
    d = MC.mlp_predict(fixed_network(), z, scores="s")
    return d.select(*K, *[r6(F.get("s", F.lit(j))).alias(f"s{j}") for j in range(CFG.k)], "predicted")


def _report_columns(df: DataFrame) -> DataFrame:
    us = [r6(F.get("memberships", F.lit(j))).alias(f"u{j}") for j in range(CFG.k)]
    num = [*FEATURES, *[f"norm_{c}" for c in FEATURES], "max_membership"]
    return df.select(*K, "followers_count", "retweet_count", "text", *[r6(c).alias(c) for c in num], "kmeans_label", "fuzzy_label", *us)


def q_model_report_fixed(spark, sf):
    posts, five, _, z, _, _ = _fitted(spark, sf)
    return _report_columns(M.model_report(posts, five, _labelled(z)))


def q_holdout_report_fixed(spark, sf):
    _, five, _, z, _, _ = _fitted(spark, sf)
    test = MC.ordered_split(_labelled(z), FX.TEST_SHARE).where("split = 'test'")
    return _rounded(M.holdout_report(five, MC.mlp_predict(fixed_network(), test)), FEATURES)


def _external(spark, sf, through_file: bool = False):
    _, _, stats, _, sent, weights = _fitted(spark, sf)
    bundle = _bundle(stats, weights)
    if through_file:
        path = scratch_dir(spark, "bundle")
        M.save_bundle(bundle, path, sent)
        bundle, sent = M.load_bundle(spark, path)
    other = P.landed_tokens(read_posts(conversation_lines(spark, sf)).drop("observed_at"))
    return P.land(M.score_external(spark, bundle, other, sent, landed=True)), other


def q_external_fixed(spark, sf):
    scored, _ = _external(spark, sf)
    return _rounded(scored.select(*K, *FEATURES, "label", "predicted"), FEATURES)


def q_saved_bundle(spark, sf):
    """Other posts scored by a bundle that was saved and loaded again."""
    scored, _ = _external(spark, sf, through_file=True)
    return _rounded(scored.select(*K, *FEATURES, "label", "predicted"), FEATURES)


def q_external_report_fixed(spark, sf):
    report = M.external_report(*_external(spark, sf))
    return _rounded(report.select(*K, "followers_count", "retweet_count", "text", *FEATURES, "predicted", "accuracy_pct"), [*FEATURES, "accuracy_pct"])


def q_write_report(spark, sf):
    """A report with texts, written as tab-separated text and read back."""
    posts = P.posts_from_tables(spark, sf)
    report = TX.with_stored_text(posts).select(*K, "followers_count", "retweet_count", F.col("stored_text").alias("text"))
    path = write_report(report, scratch_dir(spark, "report"))
    return read_report(spark, path, report.schema).withColumn("text", F.coalesce("text", F.lit("")))


def fixed_queries():
    return {
        "ingest_counts": q_ingest_counts, "merge_posts": q_merge_posts, "lexicon_emoticons": q_lexicon_emoticons, "lexicon_large": q_lexicon_large,
        "phrase_sentiment": q_phrase_sentiment, "fuzzy_cmeans_step": q_cmeans_step, "nmf_step": q_nmf_step, "match_clusterings": q_match_clusterings,
        "network_scores": q_network_scores, "model_report_fixed": q_model_report_fixed, "holdout_report_fixed": q_holdout_report_fixed,
        "external_agreement_fixed": q_external_fixed, "external_report_fixed": q_external_report_fixed, "saved_bundle": q_saved_bundle,
        "write_report": q_write_report,
    }


# -------------------------------------------------------------------------------------- DuckDB twins
EXT = f"""posts AS (SELECT role AS screen_name, CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS created_at,
      CAST(conv_id % 1000 AS BIGINT) AS followers_count, CAST(length(text) % 1500 AS BIGINT) AS retweet_count, {O.strip('text')} AS text
    FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL AND text IS NOT NULL)"""
_OWN = "posts tok ltok stoks swords sper spost sentiment entropy_t entropy_t_c entropy_t_n entropy_t_h dweight tweight five absf zf".split()
FEATS = list(O.FEATS)


def _other(cte: str) -> str:
    """The same CTE over the external posts: their own names, the lexicon and word weights of the fitted ones."""
    return re.sub(r"\b(" + "|".join(_OWN) + r")\b", r"x_\1", cte)


def _external_ctes() -> list[str]:
    five = O.five_ctes()[-1]
    z = O.standardized_ctes()
    own = [EXT, O.TOK, O.STORED, *O.sentiment_ctes(), *O.entropy_ctes(), *O.topic_ctes()[-2:], five, z[-3], z[-1]]
    return z + [_other(c) for c in own]


def _fixed_labels(src: str, name: str, centers=FX.FIXED_CENTERS) -> str:
    d = [" + ".join(f"pow({f} - ({v!r}), 2)" for f, v in zip(FEATS, c)) for c in centers]
    least = "least(" + ", ".join(f"({x})" for x in d) + ")"
    return f"{name} AS (SELECT {O.K}, CAST(CASE " + " ".join(f"WHEN ({x}) = {least} THEN {j}" for j, x in enumerate(d)) + f" END AS INTEGER) AS label FROM {src})"


def _network_ctes(src: str, prefix: str) -> list[str]:
    net, ctes, names, table = fixed_network(), [], FEATS, src
    for n, (w, b) in enumerate(zip(net.weights, net.biases)):
        last = n + 1 == len(net.weights)
        z = [" + ".join([f"({b[j]!r})".replace("np.float64", "")] + [f"{x} * ({float(w[i, j])!r})" for i, x in enumerate(names)]) for j in range(w.shape[1])]
        z = [x.replace("np.float64", "") for x in z]
        cols = [f"{x} AS s{j}" if last else f"greatest({x}, ({x}) * {MC.LEAK!r}) AS a{n}_{j}" for j, x in enumerate(z)]
        ctes.append(f"{prefix}{n} AS (SELECT {O.K}, {', '.join(cols)} FROM {table})")
        names, table = [f"a{n}_{j}" for j in range(w.shape[1])], f"{prefix}{n}"
    k = CFG.k
    top = "greatest(" + ", ".join(f"s{j}" for j in range(k)) + ")"
    arg = "CASE " + " ".join(f"WHEN s{j} = {top} THEN {j}" for j in range(k)) + " END"
    ctes.append(f"{prefix}out AS (SELECT {O.K}, {', '.join(f's{j}' for j in range(k))}, CAST({arg} AS INTEGER) AS predicted FROM {table})")
    return ctes


def _cmeans_step_sql() -> str:
    inv = ", ".join(f"pow(greatest(sqrt({' + '.join(f'pow({f} - ({v!r}), 2)' for f, v in zip(FEATS, c))}), 2.220446049250313e-16), -2.0) AS i{j}" for j, c in enumerate(FX.FIXED_CENTERS))
    k = len(FX.FIXED_CENTERS)
    total = " + ".join(f"i{j}" for j in range(k))
    rows = " UNION ALL ".join(f"SELECT CAST({j} AS INTEGER) AS label, " + ", ".join(
        f"{O.r6(f'sum(pow(i{j} / ({total}), 2) * {f}) / sum(pow(i{j} / ({total}), 2))')} AS {f}" for f in FEATS) + " FROM inv" for j in range(k))
    return O.with_(*O.standardized_ctes(), f"inv AS (SELECT *, {inv} FROM zf)") + rows


def _nmf_step_sql() -> str:
    d, r = len(FEATS), FX.BASIS_RANK
    w = [[FX.basis_value(j, i) for i in range(d)] for j in range(r)]
    gram = [[sum(w[j][i] * w[k][i] for i in range(d)) for k in range(r)] for j in range(r)]
    ctes = ["xw AS (SELECT *, " + ", ".join(" + ".join(f"{f} * {w[j][i]!r}" for i, f in enumerate(FEATS)) + f" AS x{j}, {FX.BASIS_START!r}::DOUBLE AS h0_{j}" for j in range(r)) + " FROM absf)"]
    table = "xw"
    for s in range(FX.BASIS_STEPS):
        cols = ", ".join(f"h{s}_{j} * x{j} / ({' + '.join(f'h{s}_{k} * {gram[k][j]!r}' for k in range(r))} + 1e-12) AS h{s + 1}_{j}" for j in range(r))
        ctes.append(f"hs{s + 1} AS (SELECT *, {cols} FROM {table})")
        table = f"hs{s + 1}"
    h = [f"h{FX.BASIS_STEPS}_{j}" for j in range(r)]
    sums = ", ".join([f"sum({h[j]} * {f}) AS hx{j}_{i}" for j in range(r) for i, f in enumerate(FEATS)] + [f"sum({h[j]} * {h[k]}) AS hh{j}_{k}" for j in range(r) for k in range(r)])
    ctes.append(f"sums AS (SELECT {sums} FROM {table})")
    rows = " UNION ALL ".join(f"SELECT CAST({j} AS INTEGER) AS component, " + ", ".join(
        O.r6(f"{w[j][i]!r} * hx{j}_{i} / ({' + '.join(f'hh{j}_{k} * {w[k][i]!r}' for k in range(r))} + 1e-12)") + f" AS {f}" for i, f in enumerate(FEATS)) + " FROM sums" for j in range(r))
    return O.with_(*O.standardized_ctes(), *ctes) + rows


def _matching_sql() -> str:
    k = len(FX.FIXED_CENTERS)
    perms = ", ".join(f"({n}, {a}, {b})" for n, p in enumerate(permutations(range(k))) for a, b in enumerate(p))
    return O.with_(*O.standardized_ctes(), _fixed_labels("zf", "la"), _fixed_labels("zf", "lb", FX.OTHER_CENTERS),
                   f"ct AS (SELECT la.label AS a, lb.label AS b, count(*) AS n FROM la JOIN lb USING ({O.K}) GROUP BY ALL)",
                   f"perm AS (SELECT * FROM (VALUES {perms}) t(p, a, b))",
                   "score AS (SELECT p, coalesce(sum(n), 0) AS agreeing FROM perm LEFT JOIN ct USING (a, b) GROUP BY p)",
                   "best AS (SELECT p, agreeing FROM score ORDER BY agreeing DESC, p LIMIT 1)",
                   "ra AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM ct GROUP BY a))",
                   "rb AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM ct GROUP BY b))",
                   "rc AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS n FROM ct)") + (
        "SELECT CAST(perm.a AS INTEGER) AS kmeans_label, CAST(perm.b AS INTEGER) AS matched_label, CAST(best.agreeing AS BIGINT) AS agreeing, CAST(rc.n AS BIGINT) AS total, "
        + O.r6("(rc.s - ra.s * rb.s / (rc.n * (rc.n - 1) / 2)) / ((ra.s + rb.s) / 2 - ra.s * rb.s / (rc.n * (rc.n - 1) / 2))")
        + " AS rand_index FROM best JOIN perm USING (p), ra, rb, rc WHERE perm.a IN (SELECT a FROM ct)")


def fixed_sql() -> dict[str, str]:
    k2, posts_cols = O.K, f"{O.K}, followers_count, retweet_count, text"
    lex = [O.POSTS, O.TOK, O.TERMS]
    ctes = O.sentiment_ctes()
    score = "(length(tok) * 7 + ascii(tok)) % 11 - 5"
    emo = ("emo AS (SELECT tok, " + score + r" AS score FROM (SELECT DISTINCT tok FROM stoks) WHERE regexp_matches(tok, '[^\p{L}\p{N}_'']') AND " + score + " <> 0)")
    per = (f"sper AS (SELECT {k2}, pos, sum(s) AS s FROM (SELECT {k2}, pos, sum(score) AS s FROM swords JOIN sent_lex USING (term) GROUP BY {k2}, pos "
           f"UNION ALL SELECT {k2}, pos, emo.score AS s FROM stoks JOIN emo USING (tok)) GROUP BY {k2}, pos)")
    with_emo = [ctes[0], ctes[1], emo, per, *ctes[3:]]
    valid = "doc_id IS NOT NULL AND source IS NOT NULL AND n_chars IS NOT NULL AND text IS NOT NULL"
    test = f"CAST(ceil(n * {FX.TEST_SHARE}) AS BIGINT)"
    five6 = ", ".join(f"{O.r6(f'five.{c}')} AS {c}" for c in FEATS)
    x6 = ", ".join(f"{O.r6(f'x_five.{c}')} AS {c}" for c in FEATS)
    fixed = O.memberships_sql(FX.FIXED_CENTERS)
    k = CFG.k
    ext = O.with_(*_external_ctes(), _fixed_labels("x_zf", "xlab"), *_network_ctes("x_zf", "xn"))
    external = ext + f"SELECT {k2}, {x6}, label, predicted FROM x_five JOIN xlab USING ({k2}) JOIN xnout USING ({k2})"
    return {
        "ingest_counts": (
            f"SELECT total_lines, 0::BIGINT AS blank_lines, 0::BIGINT AS broken_lines, conv AS without_original, 2 * bad AS missing_fields, 0::BIGINT AS bad_counts, "
            f"2 * good AS observations, 2 * good - n AS repeated_observations, n AS original_posts, n - {test} AS train_rows, {test} AS test_rows, {k}::BIGINT AS k FROM "
            f"(SELECT CAST((SELECT 2 * count(*) FROM documents) + (SELECT count(*) FROM conversations) AS BIGINT) AS total_lines, (SELECT count(*) FROM conversations) AS conv, "
            f"(SELECT count(*) FROM documents WHERE NOT ({valid})) AS bad, (SELECT count(*) FROM documents WHERE {valid}) AS good, "
            f"(SELECT count(*) FROM (SELECT DISTINCT source, doc_id FROM documents WHERE {valid})) AS n)"),
        "merge_posts": O.with_(O.POSTS) + f"SELECT {posts_cols} FROM posts",
        "lexicon_emoticons": O.with_(*lex, O.SENT_LEX, *with_emo) + f"SELECT {k2}, positive, negative, neutral FROM sentiment",
        "lexicon_large": O.with_(*lex, O.SENT_LEX, *ctes) + f"SELECT {k2}, positive, negative, neutral FROM sentiment",
        "fuzzy_cmeans_step": _cmeans_step_sql(),
        "nmf_step": _nmf_step_sql(),
        "match_clusterings": _matching_sql(),
        "network_scores": O.with_(*O.standardized_ctes(), *_network_ctes("zf", "net")) + (
            f"SELECT {k2}, " + ", ".join(f"{O.r6(f's{j}')} AS s{j}" for j in range(k)) + ", predicted FROM netout"),
        "model_report_fixed": O.with_(*O.standardized_ctes()) + (
            f"SELECT {k2}, followers_count, retweet_count, replace(text, chr(10), '') AS text, {five6}, "
            + ", ".join(f"{O.r6(f'zf.{c}')} AS norm_{c}" for c in FEATS)
            + f", kmeans_label, fuzzy_label, max_membership, {', '.join(f'u{j}' for j in range(k))} FROM posts JOIN five USING ({k2}) JOIN zf USING ({k2}) JOIN ({fixed}) USING ({k2})"),
        "holdout_report_fixed": O.with_(*O.standardized_ctes(), _fixed_labels("zf", "lab"), *_network_ctes("zf", "net"),
                                        f"ix AS (SELECT {k2}, row_number() OVER (ORDER BY screen_name, created_at) - 1 AS i, count(*) OVER () AS n FROM posts)") + (
            f"SELECT {k2}, {five6}, label, predicted, label = predicted AS is_equal FROM five JOIN lab USING ({k2}) JOIN netout USING ({k2}) JOIN ix USING ({k2}) WHERE i >= n - {test}"),
        "external_agreement_fixed": external,
        "saved_bundle": external,
        "external_report_fixed": ext + (
            f"SELECT {k2}, followers_count, retweet_count, replace(text, chr(10), '') AS text, {x6}, predicted, "
            f"{O.r6('(SELECT 100.0 * avg(CAST(label = predicted AS DOUBLE)) FROM xlab JOIN xnout USING (' + k2 + '))')} AS accuracy_pct "
            f"FROM x_posts JOIN x_five USING ({k2}) JOIN xnout USING ({k2})"),
        "write_report": O.with_(O.POSTS) + f"SELECT {k2}, followers_count, retweet_count, replace(text, chr(10), '') AS text FROM posts",
    }
