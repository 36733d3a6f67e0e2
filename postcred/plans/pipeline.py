"""Pipeline building blocks shared by the entries, the query catalog and the bench.

``posts`` is the hub: one row per original post, hash-partitioned by the post key after the
dedup shuffle.  Per-post columns are added row-locally; lexicon / topic aggregates group by the
same key and are joined back co-partitioned.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postcred.functions.batches import clean_tokens_and_entropy, pmi_of_text, stored_tokens_and_terms
from postcred.functions.features import retweet_ratio
from postcred.functions.text import strip_newlines
from postcred.operators import text as TX
from postcred.operators.blocks import distinct_tokens_of_each
from postcred.operators.lexicon import comparison_scores, lexicon_sentiment
from postcred.operators.topics import topic_doc_weight, topic_word_weights
from postcred.plans import fixtures as FX
from postcred.schemas import KEY
from postcred.sources import lexicons as LX
from postcred.sources.adapter import capture_lines
from postcred.sources.captures import read_posts


@dataclass(frozen=True)
class PipelineConfig:
    """Run options (the reference's command-line flags as one explicit object)."""
    k: int = 3                          # clusters
    algorithm: str = "kmeans"           # kmeans | cmeans / c-means / fuzzy
    compare_both: bool = False          # fit both clusterings and report both labels
    use_nmf: bool = False
    test_share: float = 0.25            # must be < 0.40
    fit_mode: str = "full"              # full | incremental
    mention_policy: str = "strip"       # strip | drop_row
    topics: int = 100
    vocab_size: int | None = None       # LDA vocabulary bound; None: every distinct token (the topic matrix is topics x vocab)
    min_df: float = 1.0
    lda_passes: int = 1
    lda_chunk: int = 10_000
    topic_weight_mode: str = "marginal"  # marginal | positional
    cmeans_error: float = 0.005
    cmeans_max_iter: int = 1500
    mlp_max_iter: int = 500             # per slice if fit_mode is incremental
    fit_slices: int = 4
    nmf_max_iter: int = 200
    seed: int = 21
    stopwords: tuple | None = field(default=None)


def posts_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter lines -> S2..S5 -> posts (screen_name, created_at, followers, retweets, text)."""
    return read_posts(capture_lines(spark, sf_dir)).drop("observed_at")


#: Prefix of the catalog entries of landed tables.
LANDED = "postcred_landed_"


def land(df: DataFrame, key=None, buckets: int | None = None) -> DataFrame:
    """Materialise a frame once in the shared checkpoint folder (cuts the lineage; a written
    table survives executor loss).

    With ``key`` the frame is written as a table bucketed on those columns and read back from
    it: the bucketed scan reports hash partitioning on the key, so every later per-post
    aggregation or key join runs without an exchange.  (A plain ``checkpoint()`` would lose the
    partitioning under adaptive execution.)  ``buckets`` defaults to the shuffle partition count;
    size it at roughly one bucket per few hundred MB of landed data.
    """
    import uuid

    from postcred.session import scratch_dir
    spark = df.sparkSession
    path = scratch_dir(spark, "landed")
    if key is None:  # one job: written and read back (an eager checkpoint runs the last stage twice)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"{LANDED}{uuid.uuid4().hex[:12]}"
    df.write.mode("overwrite").format("parquet").option("compression", "zstd").bucketBy(n, *key).option("path", path).saveAsTable(name)
    return spark.table(name)


def release_landed(spark: SparkSession) -> int:
    """Drop the catalog entries of landed tables (their files stay in the checkpoint folder, which the platform cleans); how many."""
    names = [t.name for t in spark.catalog.listTables() if t.name.startswith(LANDED)]
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return len(names)


def land_posts(posts: DataFrame, buckets: int | None = None) -> DataFrame:
    """Land the deduplicated posts bucketed on the post key (the hub of every feature)."""
    return land(posts, KEY, buckets)


def landed_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posts of the tables, parsed and deduplicated once: for every query that reads them more than once."""
    return land_posts(posts_from_tables(spark, sf_dir))


def landed_tokens(posts: DataFrame, stopwords=None) -> DataFrame:
    """The posts, landed with their cleaned tokens, entropy and the cleaned tokens of the stored text (``tokens``, ``entropy``, ``ltokens``)."""
    d = posts.withColumn("_t", clean_tokens_and_entropy("text", stopwords))
    d = d.withColumn("_l", clean_tokens_and_entropy(strip_newlines("text"), stopwords))
    return land_posts(d.select(*posts.columns, "_t.tokens", "_t.entropy", F.col("_l.tokens").alias("ltokens")))


def landed_texts(posts: DataFrame, stopwords=None) -> DataFrame:
    """The posts, landed with the entropy of their cleaned tokens, the cleaned tokens of the stored text as one text (``entropy``, ``ltokens``) and, in
    some rows, the distinct tokens of many (``terms``, ``lterms``, see ``landed_terms``).  No token array is written, sorted or read."""
    d = posts.withColumn("_t", stored_tokens_and_terms("text", stopwords))
    return land_posts(d.select(*posts.columns, "_t.entropy", "_t.ltokens", "_t.terms", "_t.lterms"))


def with_reach(posts: DataFrame) -> DataFrame:
    """F1 column ``nfrq``."""
    return posts.withColumn("nfrq", retweet_ratio("retweet_count", "followers_count"))


def comparison_text(posts: DataFrame, policy: str = "strip", stopwords=None) -> DataFrame:
    """T3 + T4 + T5 and the cleaned tokens of the stripped text (``stokens``)."""
    d = TX.drop_empty_posts(TX.with_url_mention_strip(posts, policy=policy))
    return TX.with_tokens(d, "text_stripped", "stokens", stopwords)


def stored_tokens(posts: DataFrame, stopwords=None, text_col: str = "text") -> DataFrame:
    """Tokens the topic model sees: cleaned stored text (newlines deleted, T6)."""
    return TX.with_tokens(TX.with_stored_text(posts, text_col), "stored_text", "ltokens", stopwords).select(*KEY, "ltokens")


def fixture_lexicons(posts: DataFrame, stopwords=None, terms: DataFrame | None = None):
    """Deterministic lexicons over the distinct cleaned terms of the posts (oracle fixtures); the terms are landed once for all three."""
    if terms is None:
        terms = land(LX.distinct_terms(posts.select(clean_tokens_and_entropy("text", stopwords)["tokens"].alias("tokens"))))
    return LX.fixture_sentiment(terms), LX.fixture_subjectivity(terms), LX.fixture_categories(terms)


def landed_terms(posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct cleaned terms of the texts and of the stored texts (see ``landed_texts``), from one pass over the distinct tokens of each batch."""
    both = land(distinct_tokens_of_each(posts.where(F.col("terms").isNotNull()), ["terms", "lterms"]).where(F.col("_word") != ""))
    return tuple(both.where(F.col("_in").bitwiseAND(F.lit(1 << i)) != 0).select(F.col("_word").alias("term")) for i in range(2))


def fixture_topic_tables(posts: DataFrame, ltok: DataFrame, terms: DataFrame | None = None):
    """Fixed stand-ins for a topic model: per-post mixture and per-topic word distribution."""
    k = FX.FIXTURE_TOPICS
    ws = F.array(*[F.expr(FX.theta_weight_sql(t, "text")) for t in range(k)])
    dt = posts.select(*KEY, ws.alias("_w")).withColumn("_tot", F.aggregate("_w", F.lit(0.0), lambda a, x: a + x))
    dt = dt.select(*KEY, "_tot", F.posexplode("_w").alias("topic_id", "w")).select(
        *KEY, "topic_id", (F.col("w") / F.col("_tot")).alias("prob"))
    terms = land(LX.distinct_terms(ltok, "ltokens")) if terms is None else terms
    phis = F.array(*[F.expr(FX.phi_weight_sql(t, "term")) for t in range(k)])
    tt = terms.select("term", F.posexplode(phis).alias("topic_id", "raw"))
    # one row per topic: bounded by the topic count
    tot = tt.groupBy("topic_id").agg(F.sum("raw").alias("_tot"))
    tt = tt.join(F.broadcast(tot), "topic_id").select("topic_id", "term", (F.col("raw") / F.col("_tot")).alias("weight"))
    return dt, tt


def five_feature_frame(posts: DataFrame, sentiment_lex: DataFrame, weights: DataFrame,
                       stopwords=None, topic_text: str = "text", landed: bool = False, topic_weight: DataFrame | None = None) -> DataFrame:
    """F9 for the five-feature model: nfrq, positive, negative, entropy, topic_weight (of ``topic_text``).

    ``landed``: the posts are a table from ``landed_texts`` or ``landed_tokens``, one row per key, with their entropy and the topic text's tokens.
    ``topic_weight``: F8 of these posts and ``weights``, if it is there already.
    """
    reach = with_reach(posts)
    tok = reach if landed else TX.with_text_stats(TX.with_tokens(reach, stopwords=stopwords), pmi=None)
    sent = lexicon_sentiment(posts, sentiment_lex, landed=landed, unique=landed)
    tw = topic_weight if topic_weight is not None else topic_doc_weight(posts if landed else stored_tokens(posts, stopwords, topic_text), weights, tokens="ltokens", landed=landed, unique=landed)
    return (tok.select(*KEY, "nfrq", "entropy").join(sent, list(KEY)).join(tw, list(KEY))
            .select(*KEY, "nfrq", F.col("positive").cast("double").alias("positive"),
                    F.col("negative").cast("double").alias("negative"), "entropy", "topic_weight"))


def fixture_five_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F9 with fixture lexicon and fixture topic tables (fully deterministic, oracle-checked)."""
    return fixture_fit(spark, sf_dir)[1]


def fixture_fit(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(posts, five features, sentiment lexicon, topic weights); everything that is read more than once is landed, tokens with their posts."""
    posts = landed_texts(posts_from_tables(spark, sf_dir))
    words, stored_words = landed_terms(posts)
    sent_lex, _, _ = fixture_lexicons(posts, terms=words)
    dt, tt = fixture_topic_tables(posts, posts, stored_words)
    weights = land(topic_word_weights(dt, tt, mode="marginal"))
    five = land(five_feature_frame(posts, sent_lex, weights, landed=True))
    return posts.drop("entropy", "ltokens", "terms", "lterms"), five, sent_lex, weights


def otc_frame(posts: DataFrame, subj_lex: DataFrame, cat_lex: DataFrame, policy: str = "strip",
              stopwords=None) -> DataFrame:
    """Comparison-only columns: pmi, subjectivity, deception index, OTC parts and score."""
    from postcred.functions.features import otc_parts, otc_score
    ct = TX.drop_empty_posts(TX.with_url_mention_strip(posts, policy=policy)).withColumn("pmi", pmi_of_text("text_stripped", stopwords))
    ct = land(ct.select(*KEY, "pmi", "text_stripped"), KEY)  # a Python function's rows have no known partitioning
    # one pass over the stripped text: pmi in the row, both lexicons on the same exploded words
    j = comparison_scores(ct, subj_lex, cat_lex, carry=["pmi"], landed=True).select(*KEY, "pmi", "subjectivity", "deception_index")
    j = j.withColumn("otc_parts", otc_parts("pmi", "subjectivity", "deception_index"))
    return j.withColumn("otc_score", otc_score("otc_parts"))
