"""Model pipeline (entries A and C) and the model-based queries (rows-only checks).

Entry A: posts -> five features (LDA topic weights) -> abs -> standardise -> optional NMF ->
k-means and/or fuzzy c-means -> training labels -> ordered split -> network -> holdout metrics.
Entry C: score another capture set with the fitted bundle (scaler, basis, centres, network).

The feature table is checkpointed once (reliable checkpoint in the cluster's checkpoint folder):
every iterative fit then scans a short, recomputation-safe lineage.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postcred.operators import classify as MC
from postcred.operators import cluster as CL
from postcred.operators import evaluate as EV
from postcred.operators import features as FE
from postcred.operators import topics as TP
from postcred.operators.factorize import NmfModel, nmf_apply, nmf_fit
from postcred.plans import fixtures as FX
from postcred.plans import pipeline as P
from postcred.schemas import FEATURES, KEY
from postcred.session import checkpoint_dir, scratch_dir
from postcred.sources.captures import (dedup_posts, filter_originals, project_original, read_captures)
from postcred.sources.adapter import write_capture_folder
from postcred.sources.tables import read_feature_table, read_report, write_feature_table, write_report

K = list(KEY)


# ------------------------------------------------------------------ topic weights from a fitted model
@dataclass
class TopicArtifacts:
    model: TP.TopicModel
    theta: DataFrame        # (key, theta) of every post
    weights: DataFrame      # (term, weight)


def fit_topic_weights(spark, posts: DataFrame, cfg: P.PipelineConfig,
                      text_col: str = "text") -> tuple[DataFrame, TopicArtifacts]:
    """F5 -> F6 -> F7 -> F8: ``(key, topic_weight)`` for every post."""
    ltok = P.stored_tokens(posts, cfg.stopwords, text_col)
    model = TP.fit_topics(ltok, "ltokens", k=cfg.topics, passes=cfg.lda_passes, chunk_size=cfg.lda_chunk, seed=cfg.seed,
                          vocab_size=cfg.vocab_size, min_df=cfg.min_df, key=K)
    theta = P.land(TP.topic_mixtures(model) if model.seen else TP.topic_mixtures(model, ltok, "ltokens"))
    if cfg.topic_weight_mode == "positional":
        weights = TP.model_word_weights(model, doc_topics=theta.select(*K, F.posexplode("theta").alias("topic_id", "prob")), mode="positional")
    else:
        weights = TP.model_word_weights(model, theta=theta)
    weights = P.land(weights)
    tw = TP.topic_doc_weight(ltok, weights, tokens="ltokens")
    return tw, TopicArtifacts(model, theta, weights)


def model_features(spark, posts: DataFrame, sentiment_lex: DataFrame, cfg: P.PipelineConfig):
    """F9 with LDA topic weights, checkpointed (the input of every fit below)."""
    tw, art = fit_topic_weights(spark, posts, cfg)
    five = P.five_feature_frame(posts, sentiment_lex, art.weights, cfg.stopwords, topic_weight=tw)
    return P.land(five), art


def comparison_posts(posts: DataFrame, cfg: P.PipelineConfig) -> DataFrame:
    """Entry B's posts, landed: with ``text_stripped`` (URLs and mentions gone by the policy); emptied posts are dropped."""
    kept = P.comparison_text(posts, cfg.mention_policy, cfg.stopwords)
    return P.land_posts(kept.select(*posts.columns, "text_stripped"))


def comparison_five(kept: DataFrame, sentiment_lex: DataFrame, weights: DataFrame, cfg: P.PipelineConfig, topic_weight: DataFrame | None = None) -> DataFrame:
    """F9 + F10 for entry B: topic weight of the stripped text, the other features of the original; rows by their maximum."""
    return FE.row_max_normalize(P.five_feature_frame(kept, sentiment_lex, weights, cfg.stopwords, "text_stripped", topic_weight=topic_weight))


def comparison_model(spark, posts: DataFrame, sentiment_lex: DataFrame, subj_lex: DataFrame, cat_lex: DataFrame,
                     cfg: P.PipelineConfig):
    """Entry B: the rival-score run.  Returns (bundle, report, holdout predictions); the report has the OTC score."""
    kept = comparison_posts(posts, cfg)
    tw, art = fit_topic_weights(spark, kept, cfg, "text_stripped")
    five = P.land(comparison_five(kept, sentiment_lex, art.weights, cfg, tw))
    bundle, labelled, pred = fit_model(spark, five, cfg, art.weights)
    otc = P.otc_frame(posts, subj_lex, cat_lex, cfg.mention_policy, cfg.stopwords)
    stripped = kept.withColumn("text", F.col("text_stripped"))
    return bundle, model_report(stripped, five, labelled, otc), pred


@dataclass
class ModelBundle:
    """Everything needed to score new posts the way the training posts were scored."""
    cfg: P.PipelineConfig
    stats: FE.StandardStats
    nmf: NmfModel | None
    kmeans_centers: list | None
    fuzzy_centers: list | None
    net: object
    weights: DataFrame
    diagnostics: dict = field(default_factory=dict)  # per iterative fit: iterations, last error, converged


BUNDLE_FORMAT = 1


def save_bundle(bundle: ModelBundle, path: str, lexicon: DataFrame | None = None) -> int:
    """Write a bundle as the next version under ``path``; returns its number.

    The tables (word weights, optionally the sentiment lexicon the features were made with) are written first, the manifest with
    everything small (config, scaler, basis, both centre sets, network, diagnostics) last, so a version counts once it is whole.
    """
    spark = SparkSession.getActiveSession()
    number = max(bundle_versions(spark, path), default=0) + 1
    root = f"{path.rstrip('/')}/v{number:06d}"
    tables = {"weights": bundle.weights, "lexicon": lexicon}
    for name, table in tables.items():
        if table is not None:
            table.write.mode("overwrite").parquet(f"{root}/{name}")
    nmf = bundle.nmf
    head = {"format": BUNDLE_FORMAT, "config": {**vars(bundle.cfg), "stopwords": list(bundle.cfg.stopwords) if bundle.cfg.stopwords is not None else None},
            "stats": {"cols": list(bundle.stats.cols), "means": list(bundle.stats.means), "scales": list(bundle.stats.scales)},
            "nmf": None if nmf is None else {**vars(nmf), "cols": list(nmf.cols)},
            "kmeans_centers": bundle.kmeans_centers, "fuzzy_centers": bundle.fuzzy_centers, "net": bundle.net.to_json(),
            "diagnostics": bundle.diagnostics, "tables": [n for n, t in tables.items() if t is not None]}
    spark.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/manifest")
    return number


def bundle_versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the whole versions under ``path``."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    out = []
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("v") and name[1:].isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "manifest/_SUCCESS")):
            out.append(int(name[1:]))
    return sorted(out)


def load_bundle(spark: SparkSession, path: str, number: int | None = None) -> tuple[ModelBundle, DataFrame | None]:
    """(bundle, sentiment lexicon if one was saved) of a version, the newest by default; nothing is fitted again."""
    versions = bundle_versions(spark, path)
    if not versions or (number is not None and number not in versions):
        raise FileNotFoundError(f"no whole model version under {path}")
    root = f"{path.rstrip('/')}/v{number or versions[-1]:06d}"
    head = json.loads(spark.read.text(f"{root}/manifest").first()["value"])
    if head["format"] != BUNDLE_FORMAT:
        raise ValueError(f"model format {head['format']} is not {BUNDLE_FORMAT}")
    cfg = dict(head["config"])
    cfg["stopwords"] = tuple(cfg["stopwords"]) if cfg["stopwords"] is not None else None
    s, n = head["stats"], head["nmf"]
    tables = {name: spark.read.parquet(f"{root}/{name}") for name in head["tables"]}
    bundle = ModelBundle(P.PipelineConfig(**cfg), FE.StandardStats(tuple(s["cols"]), tuple(s["means"]), tuple(s["scales"])),
                         None if n is None else NmfModel(**{**n, "cols": tuple(n["cols"])}), head["kmeans_centers"], head["fuzzy_centers"],
                         MC.Network.from_json(head["net"]), tables.get("weights"), head["diagnostics"])
    return bundle, tables.get("lexicon")


def cluster_features(df: DataFrame, bundle_stats: FE.StandardStats, nmf: NmfModel | None) -> DataFrame:
    """abs -> standardise (fitted stats) -> optional NMF coordinates -> standardise -> abs."""
    z = FE.standardize_apply(FE.abs_features(df), bundle_stats)
    if nmf is None:
        return z
    coords = nmf_apply(FE.abs_features(df), nmf)
    return FE.abs_features(FE.standardize_apply(coords, bundle_stats))


def label_posts(df: DataFrame, cfg: P.PipelineConfig, kmeans_centers, fuzzy_centers) -> DataFrame:
    """C2 / C4 / C5 with fitted centres, then C7."""
    out = df
    if fuzzy_centers is not None:
        out = CL.membership_max(CL.fuzzy_memberships(out, fuzzy_centers))
    else:
        out = out.withColumn("memberships", F.lit(None).cast("array<double>")) \
            .withColumn("max_membership", F.lit(None).cast("double")).withColumn("fuzzy_label", F.lit(None).cast("int"))
    if kmeans_centers is not None:
        out = CL.kmeans_assign(out, kmeans_centers)
    else:
        out = out.withColumn("kmeans_label", F.lit(None).cast("int"))
    return CL.training_labels(out, cfg.algorithm)


def _wants_fuzzy(cfg) -> bool:
    a = cfg.algorithm.lower()
    return "cmeans" in a or "c-means" in a or "fuzzy" in a


def fit_model(spark, five: DataFrame, cfg: P.PipelineConfig, weights: DataFrame | None = None):
    """Entry A after F9: scaling, optional NMF, clustering, labels, split, network, holdout."""
    stats = FE.standardize_fit(FE.abs_features(five))
    diagnostics = {}
    nmf = nmf_fit(FE.abs_features(five), seed=0, max_iter=cfg.nmf_max_iter) if cfg.use_nmf else None
    if nmf is not None:
        diagnostics["nmf"] = {"iterations": nmf.iterations, "error": nmf.errors[-1] if nmf.errors else None,
                              "converged": nmf.iterations < cfg.nmf_max_iter}
    # checkpoint cuts the lineage (safe against executor loss); cache serves the fit iterations
    feats = P.land(cluster_features(five, stats, nmf)).persist()
    fuzzy = _wants_fuzzy(cfg)
    km_centers = fz_centers = None
    if not fuzzy or cfg.compare_both:
        _, km_centers = CL.kmeans_fit(feats, cfg.k, seed=cfg.seed)
    if fuzzy or cfg.compare_both:
        fuzzy_fit = CL.fuzzy_cmeans_fit(feats, cfg.k, error=cfg.cmeans_error, max_iter=cfg.cmeans_max_iter, seed=cfg.seed)
        fz_centers = fuzzy_fit.centers
        diagnostics["cmeans"] = {"iterations": fuzzy_fit.iterations, "error": fuzzy_fit.error,
                                 "converged": fuzzy_fit.error < cfg.cmeans_error}
    labelled = label_posts(feats, cfg, km_centers, fz_centers)
    split = MC.ordered_split(labelled, cfg.test_share)
    train = split.where(F.col("split") == "train")
    test = split.where(F.col("split") == "test")
    if cfg.fit_mode == "full":
        net = MC.mlp_fit(train, cfg.k, max_iter=cfg.mlp_max_iter, seed=cfg.seed)
    else:
        net = MC.mlp_fit_incremental(_slices(train, cfg.fit_slices), cfg.k, max_iter_per_batch=cfg.mlp_max_iter, seed=cfg.seed)
    pred = MC.mlp_predict(net, test)
    bundle = ModelBundle(cfg, stats, nmf, km_centers, fz_centers, net, weights, diagnostics)
    return bundle, labelled, pred


def _slices(df: DataFrame, n: int):
    """Contiguous slices of the ordered training rows (by their dense index) for warm starts."""
    total = df.count()
    step = max(1, -(-total // n))
    lo = df.agg(F.min("row_index")).first()[0] or 0
    for i in range(n):
        part = df.where((F.col("row_index") >= lo + i * step) & (F.col("row_index") < lo + (i + 1) * step))
        yield part


def holdout_report(five: DataFrame, pred: DataFrame) -> DataFrame:
    """R2: raw features of the test rows with label, prediction and agreement flag."""
    return (five.join(pred.select(*K, "label", "predicted"), K)
            .withColumn("is_equal", F.col("label") == F.col("predicted")))


def model_report(posts: DataFrame, five: DataFrame, labelled: DataFrame, otc: DataFrame | None = None) -> DataFrame:
    """Post fields, raw features, both labels, memberships and normalised features."""
    norm = labelled.select(*K, *[F.col(c).alias(f"norm_{c}") for c in FEATURES], "kmeans_label",
                           "memberships", "max_membership", "fuzzy_label")
    stored = posts.select(*K, "followers_count", "retweet_count",
                          F.replace(F.col("text"), F.lit("\n"), F.lit("")).alias("text"))
    out = stored.join(five, K).join(norm, K)
    if otc is not None:
        out = out.join(otc.select(*K, "otc_score"), K, "left")
    return out


def score_external(spark, bundle: ModelBundle, posts: DataFrame, sentiment_lex: DataFrame, landed: bool = False) -> DataFrame:
    """Entry C / E5: features of other posts with the *fitted* topic weights, scaler, basis,
    centres and network; predicted label next to the clustering label.  ``landed``: see ``five_feature_frame``."""
    five = P.land(P.five_feature_frame(posts, sentiment_lex, bundle.weights, bundle.cfg.stopwords, landed=landed))  # read twice
    return score_features(bundle, five)


def external_report(scored: DataFrame, posts: DataFrame) -> DataFrame:
    """R3 for a capture folder: post fields, features, both labels and the share of equal labels in percent."""
    share = EV.accuracy(scored).first()["accuracy_pct"]  # one row
    fields = posts.select(*K, "followers_count", "retweet_count", F.replace("text", F.lit("\n"), F.lit("")).alias("text"))
    return fields.join(scored, K).withColumn("accuracy_pct", F.lit(share).cast("double"))


def score_features(bundle: ModelBundle, five: DataFrame) -> DataFrame:
    """E5 / R3 on a feature table: the post key, if the table has none, is a row number as text."""
    if any(c not in five.columns for c in K):
        numbered = F.monotonically_increasing_id().cast("string")
        five = P.land(five.select(numbered.alias(K[0]), F.lit("").alias(K[1]), *FEATURES))
    feats = cluster_features(five, bundle.stats, bundle.nmf)
    labelled = label_posts(feats, bundle.cfg, bundle.kmeans_centers, bundle.fuzzy_centers)
    pred = MC.mlp_predict(bundle.net, labelled)
    return five.join(pred.select(*K, "label", "predicted"), K)


# ------------------------------------------------------------------ registered model queries
SMALL = P.PipelineConfig(k=3, algorithm="kmeans", compare_both=True, topics=10, mlp_max_iter=100,
                         cmeans_max_iter=100)


def _posts_and_lex(spark, sf):
    posts = P.landed_posts(spark, sf)
    sent, subj, cats = P.fixture_lexicons(posts)
    return posts, sent, subj, cats


def _fitted_topics(spark, sf):
    ltok = P.stored_tokens(P.landed_posts(spark, sf))
    return TP.fit_topics(ltok, "ltokens", k=SMALL.topics, seed=SMALL.seed, key=K)


def q_fit_topics(spark, sf):
    """The whole fitted model, one row per topic and term."""
    return TP.model_topic_terms(_fitted_topics(spark, sf))


def q_topic_distribution(spark, sf):
    return TP.topic_distribution(_fitted_topics(spark, sf))


def q_topic_weights_positional(spark, sf):
    model = _fitted_topics(spark, sf)
    return TP.model_word_weights(model, doc_topics=TP.topic_distribution(model), mode="positional")


def q_lda_five_features(spark, sf):
    posts, sent, _, _ = _posts_and_lex(spark, sf)
    five, _ = model_features(spark, posts, sent, SMALL)
    return five


def _fixture_feats(spark, sf):
    five = P.fixture_five_features(spark, sf)
    stats = FE.standardize_fit(FE.abs_features(five))
    return five, P.land(FE.standardize_apply(FE.abs_features(five), stats)).persist()


def q_kmeans_fit(spark, sf):
    _, z = _fixture_feats(spark, sf)
    _, centers = CL.kmeans_fit(z, SMALL.k, seed=SMALL.seed)
    return CL.kmeans_assign(z, centers).select(*K, "kmeans_label")


def q_fuzzy_cmeans_fit(spark, sf):
    _, z = _fixture_feats(spark, sf)
    res = CL.fuzzy_cmeans_fit(z, SMALL.k, max_iter=SMALL.cmeans_max_iter, seed=SMALL.seed)
    m = CL.membership_max(CL.fuzzy_memberships(z, res.centers))
    return m.select(*K, *[F.get("memberships", j).alias(f"u{j}") for j in range(SMALL.k)],
                    "max_membership", "fuzzy_label")


def q_nmf_fit(spark, sf):
    five, _ = _fixture_feats(spark, sf)
    a = FE.abs_features(five)
    model = nmf_fit(a, max_iter=30)
    return nmf_apply(a, model, [f"h{j}" for j in range(5)])


def q_nmf_basis(spark, sf):
    five, _ = _fixture_feats(spark, sf)
    model = nmf_fit(FE.abs_features(five), max_iter=30)
    return spark.createDataFrame([(i, *row) for i, row in enumerate(model.basis)],
                                 "component int, " + ", ".join(f"{c} double" for c in FEATURES))


def q_save_load_model(spark, sf):
    _, z = _fixture_feats(spark, sf)
    model, centers = CL.kmeans_fit(z, SMALL.k, seed=SMALL.seed)
    path = scratch_dir(spark, "kmeans-model")
    CL.save_kmeans(model, path)
    _, loaded = CL.load_kmeans(path)
    return CL.kmeans_assign(z, loaded).select(*K, "kmeans_label")


# network queries: one clustering (k-means labels); c-means has its own query and the model report
FIT = P.PipelineConfig(k=3, algorithm="kmeans", topics=10, mlp_max_iter=100)


def _fixture_fit(spark, sf, cfg=FIT):
    five, _ = _fixture_feats(spark, sf)
    return five, fit_model(spark, five, cfg)


def q_mlp_predict(spark, sf):
    _, (_, _, pred) = _fixture_fit(spark, sf)
    return EV.prediction_match(pred.select(*K, "label", "predicted"))


def q_mlp_fit_incremental(spark, sf):
    cfg = P.PipelineConfig(k=3, algorithm="kmeans", fit_mode="incremental", mlp_max_iter=20)
    _, (_, _, pred) = _fixture_fit(spark, sf, cfg)
    return EV.prediction_match(pred.select(*K, "label", "predicted"))


def q_stream_incremental_fit(spark, sf):
    """M3 on Structured Streaming: labelled training rows arrive as files; every micro-batch
    continues training from the previous weights; the held-out rows are then scored."""
    from postcred.streaming.incremental import IncrementalTrainer, train_on_stream
    five, _ = _fixture_feats(spark, sf)
    stats = FE.standardize_fit(FE.abs_features(five))
    feats = P.land(cluster_features(five, stats, None)).persist()
    _, centers = CL.kmeans_fit(feats, FIT.k, seed=FIT.seed)
    split = MC.ordered_split(CL.training_labels(CL.kmeans_assign(feats, centers), "kmeans"), FIT.test_share)
    src = scratch_dir(spark, "train-stream")
    (split.where(F.col("split") == "train").select(*FEATURES, "label")
     .repartition(4, F.xxhash64(*FEATURES)).write.mode("overwrite").parquet(src))
    schema = spark.read.parquet(src).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    trainer = IncrementalTrainer(FIT.k, max_iter_per_batch=20, seed=FIT.seed, state_dir=scratch_dir(spark, "train-stream-model"))
    train_on_stream(stream, trainer, scratch_dir(spark, "train-stream-ckpt"))
    pred = MC.mlp_predict(trainer.model, split.where(F.col("split") == "test"))
    return EV.prediction_match(pred.select(*K, "label", "predicted"))


def q_holdout_report(spark, sf):
    five, (_, _, pred) = _fixture_fit(spark, sf)
    return holdout_report(five, pred)


def q_holdout_metrics(spark, sf):
    _, (_, _, pred) = _fixture_fit(spark, sf)
    return EV.classification_report(pred)


def q_model_report(spark, sf):
    posts, sent, subj, cats = _posts_and_lex(spark, sf)
    cfg = P.PipelineConfig(k=3, algorithm="fuzzy c-means", compare_both=True, topics=10,
                           mlp_max_iter=100, cmeans_max_iter=100)
    five, art = model_features(spark, posts, sent, cfg)
    bundle, labelled, _ = fit_model(spark, five, cfg, art.weights)
    otc = P.otc_frame(posts, subj, cats)
    rep = model_report(posts, five, labelled, otc)
    path = write_report(rep, scratch_dir(spark, "model-report"))
    return read_report(spark, path)


def q_nmf_model(spark, sf):
    cfg = P.PipelineConfig(k=3, algorithm="kmeans", use_nmf=True, mlp_max_iter=100)
    _, (_, labelled, _) = _fixture_fit(spark, sf, cfg)
    return labelled.select(*K, *FEATURES, "kmeans_label", "label")


def q_comparison_report(spark, sf):
    """Entry B end to end: stripped posts, row-max features, both clusterings, OTC score."""
    posts, sent, subj, cats = _posts_and_lex(spark, sf)
    _, report, _ = comparison_model(spark, posts, sent, subj, cats, SMALL)
    return report


def q_external_feature_table(spark, sf):
    """E5 / R3 on a feature table without keys, written and read back as tab-separated text."""
    five, (bundle, _, _) = _fixture_fit(spark, sf)
    path = scratch_dir(spark, "feature-table")
    write_feature_table(five.select(*FEATURES), path)
    return score_features(bundle, read_feature_table(spark, path)).select(*FEATURES, "label", "predicted")


def _external(spark, sf):
    """Fit on the first capture folder, score the later capture of the same posts: (scored, later posts)."""
    root = write_capture_folder(spark, sf)
    first = dedup_posts(project_original(filter_originals(read_captures(spark, f"{root}/FlumeData-1"))))
    later = dedup_posts(project_original(filter_originals(read_captures(spark, f"{root}/FlumeData-2"))))
    sent, _, _ = P.fixture_lexicons(first)
    cfg = P.PipelineConfig(k=3, algorithm="kmeans", topics=10, mlp_max_iter=100)
    five, art = model_features(spark, first, sent, cfg)
    bundle, _, _ = fit_model(spark, five, cfg, art.weights)
    return P.land(score_external(spark, bundle, later, sent)), later


def q_external_report(spark, sf):
    return external_report(*_external(spark, sf))


def q_external_accuracy(spark, sf):
    return EV.accuracy(_external(spark, sf)[0])


def model_queries():
    return {
        "fit_topics": q_fit_topics,
        "topic_distribution": q_topic_distribution,
        "topic_weights_positional": q_topic_weights_positional,
        "lda_five_features": q_lda_five_features,
        "kmeans_fit": q_kmeans_fit,
        "fuzzy_cmeans_fit": q_fuzzy_cmeans_fit,
        "nmf_fit": q_nmf_fit,
        "nmf_basis": q_nmf_basis,
        "nmf_model": q_nmf_model,
        "save_load_model": q_save_load_model,
        "mlp_predict": q_mlp_predict,
        "mlp_fit_incremental": q_mlp_fit_incremental,
        "stream_incremental_fit": q_stream_incremental_fit,
        "holdout_report": q_holdout_report,
        "holdout_metrics": q_holdout_metrics,
        "model_report": q_model_report,
        "external_report": q_external_report,
        "external_feature_table": q_external_feature_table,
        "comparison_report": q_comparison_report,
        "external_agreement": q_external_accuracy,
    }
