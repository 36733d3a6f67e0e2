"""Topic features.

F5 is variational Bayes over the cleaned stored text with the word-topic counts in a table, one row of ``k`` counts per
term; nothing that grows with the vocabulary or the posts passes the driver, which holds ``k`` totals only.  Posts
are dealt into blocks, blocks into chunks, and a pass visits every chunk once, so each post counts exactly once a pass.
For a chunk, the rows of the terms that its blocks hold are joined to the blocks, every post's mixture is solved inside
its block, and the expected counts are summed by term (map-side first: a term that every post holds is one
row per task) and blended into those terms' rows.  A term that a chunk does not hold only decays towards ``eta``, by a factor that is known
without its row.  So a blended row is sent on to the next chunk that holds the term and read there alone: a pass
reads and writes each chunk's own terms, never the whole table, and costs what its posts cost.

F6 reads the posts' mixtures, F7 turns the model into a word -> weight table, F8 sums word weights over a post's tokens.
F7/F8 take plain tables (``doc_topics``: key, topic_id, prob; ``topic_terms``: topic_id, term,
weight; ``vocabulary``: term, term_index), so they work on a fitted model or on given tables.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postcred.operators.blocks import look_up, written as _written
from postcred.operators.joins import DEFAULT_MAX_BROADCAST_ROWS
from postcred.schemas import KEY
from postcred.session import scratch_dir

# Topic count of the reference's LDA call (library default).
DEFAULT_TOPICS = 100
#: Most inner steps of a post's mixture, and the mean change of its topic counts below which it is settled.
INNER_STEPS, INNER_TOLERANCE = 50, 1e-3
#: (post, term) pairs of a block, and of the rows worked on at once inside it.
BLOCK_PAIRS, WORK_PAIRS = 200_000, 20_000


@dataclass
class TopicModel:
    """``words``: (term, n, lam array<double>) with the word-topic counts; ``totals``: their sums per topic."""
    words: DataFrame
    totals: list[float]
    k: int
    alpha: float
    eta: float
    bounds: list[float]  # mean log-likelihood per token seen in each pass, before the pass's own update of a chunk
    seen: tuple[DataFrame, DataFrame] | None = None  # the posts of the fit (their key, post) and their bags; not saved

    def save(self, path: str) -> None:
        self.words.write.mode("overwrite").parquet(f"{path}/words")
        spark = self.words.sparkSession
        head = json.dumps({"totals": self.totals, "k": self.k, "alpha": self.alpha, "eta": self.eta, "bounds": self.bounds})
        spark.createDataFrame([(head,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "TopicModel":
        head = json.loads(spark.read.text(f"{path}/model").first()["value"])
        return TopicModel(spark.read.parquet(f"{path}/words"), head["totals"], head["k"], head["alpha"], head["eta"], head["bounds"])


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of log gamma for positive numbers: upward recurrence to 6, then the asymptotic series."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    for _ in range(6):
        low = x < 6
        if not low.any():
            break
        out[low] -= 1 / x[low]
        x[low] += 1
    r = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r * (1 / 132)))))


def solve_mixtures(post: np.ndarray, beta: np.ndarray, n: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Topic counts (gamma) of each post, and of each (post, term) pair the log of its probability.

    ``post`` (0, 1, .. without gaps, rising) and ``n`` describe the pairs; ``beta`` has their terms' rows exp E[log phi].  Each post stops
    by its own change, so the result does not depend on which posts are solved together.
    """
    n_posts, k = int(post[-1]) + 1 if len(post) else 0, beta.shape[1]
    gamma = np.ones((n_posts, k))
    first = np.searchsorted(post, np.arange(n_posts))
    size = np.diff(np.append(first, len(post)))
    # ``held``: the posts whose pairs are at hand, gathered anew once many of them are settled; settled ones among them are left as they are
    live = held = np.arange(n_posts)
    b, count, start, who = beta, n, first, post
    theta = np.exp(digamma(gamma) - digamma(gamma.sum(axis=1))[:, None])
    for _ in range(INNER_STEPS):
        if not len(live):
            break
        if 4 * len(live) < 3 * len(held):
            held = live
            start = np.cumsum(size[held]) - size[held]
            at = np.repeat(first[held] - start, size[held]) + np.arange(size[held].sum())
            b, count, who = beta[at], n[at], np.repeat(np.arange(len(held)), size[held])
        t = theta[held]
        norm = np.einsum("ij,ij->i", t[who], b) + 1e-100
        new = alpha + t * np.add.reduceat(b * (count / norm)[:, None], start, axis=0)
        if len(live) < len(held):
            new = new[np.searchsorted(held, live)]
        moved = np.abs(new - gamma[live]).mean(axis=1)
        gamma[live] = new
        theta[live] = np.exp(digamma(new) - digamma(new.sum(axis=1))[:, None])
        live = live[moved >= INNER_TOLERANCE]
    return gamma, theta


def _ranges(post: np.ndarray):
    """Ranges of whole posts of about ``WORK_PAIRS`` pairs."""
    lo = 0
    while lo < len(post):
        hi = min(len(post), lo + WORK_PAIRS)
        if hi < len(post):
            back = int(np.searchsorted(post, post[hi]))
            hi = back if back > lo else int(np.searchsorted(post, post[hi], side="right"))
        yield lo, hi
        lo = hi


def _block(left: pa.Table, right: pa.Table, totals: np.ndarray):
    """(distinct posts, pair arrays in the order of posts and terms, terms, their rows, the rows' exp E[log phi]) of a block."""
    right = right.sort_by("word")  # each term once: the pairs themselves are put in order by number
    terms = right.column("word").combine_chunks()
    lam = right.column("lam").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(terms), -1)
    beta = np.exp(digamma(lam) - digamma(totals))
    at = pc.index_in(left.column("term").combine_chunks(), value_set=terms)
    known = at.is_valid().to_numpy(zero_copy_only=False)  # a term without a row is unknown
    at = at.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
    ids, post = np.unique(left.column("post").to_numpy()[known], return_inverse=True)
    post = post.reshape(-1).astype(np.int64)
    order = np.argsort(post * max(len(terms), 1) + at)
    return ids, post[order], at[order], left.column("n").to_numpy().astype(float)[known][order], terms, lam, beta


def _expected_counts(k: int, alpha: float, totals: np.ndarray):
    """Of a block: (term, v) expected topic counts of each term, and one row (null, [log-likelihood, tokens, ..])."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        _, post, at, n, terms, lam, beta = _block(left, right, totals)
        share = lam / totals
        out, score, tokens = np.zeros((len(terms), k)), 0.0, 0.0
        for lo, hi in _ranges(post):
            p = post[lo:hi] - post[lo]
            gamma, theta = solve_mixtures(p, beta[at[lo:hi]], n[lo:hi], alpha)
            t, b = theta[p], at[lo:hi]
            norm = (t * beta[b]).sum(axis=1) + 1e-100
            order = np.argsort(b, kind="stable")
            starts = np.flatnonzero(np.concatenate([[True], b[order][1:] != b[order][:-1]]))
            out[b[order][starts]] += np.add.reduceat((t * (n[lo:hi] / norm)[:, None])[order], starts, axis=0)
            mix = gamma / gamma.sum(axis=1)[:, None]
            score += float((n[lo:hi] * np.log((mix[p] * share[b]).sum(axis=1) + 1e-100)).sum())
            tokens += float(n[lo:hi].sum())
        values = np.vstack([out * beta, [[score, tokens] + [0.0] * (k - 2)] if k > 1 else [[score]]])
        names = pa.chunked_array([terms.cast(pa.string()), pa.array([None], pa.string())]).combine_chunks()
        return pa.table({"term": names, "v": pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), k).cast(pa.list_(pa.float64()))})
    return run


def _mixtures(alpha: float, totals: np.ndarray):
    """Of a block: (post, theta)."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, post, at, n, _, _, beta = _block(left, right, totals)
        k, out = beta.shape[1] if len(beta) else len(totals), []
        for lo, hi in _ranges(post):
            gamma, _ = solve_mixtures(post[lo:hi] - post[lo], beta[at[lo:hi]], n[lo:hi], alpha)
            out.append(gamma / gamma.sum(axis=1)[:, None])
        theta = np.concatenate(out) if out else np.empty((0, k))
        return pa.table({"post": pa.array(ids, pa.int64()),
                         "theta": pa.FixedSizeListArray.from_arrays(pa.array(theta.ravel()), k).cast(pa.list_(pa.float64()))})
    return run


def start_counts(term: Column, k: int, seed: int) -> Column:
    """Topic counts to begin with: around one, spread by a hash of the term (about 0.1), so runs repeat."""
    def one(i: Column) -> Column:
        parts = [(F.xxhash64(term, i, F.lit(seed), F.lit(j)).bitwiseAND(0xFFFFFF) / F.lit(float(1 << 24))) for j in range(3)]
        return F.lit(1.0) + F.lit(0.2) * (parts[0] + parts[1] + parts[2] - F.lit(1.5))
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), one)


#: Posts whose tokens are counted at once.
BAG_ROWS = 1_000


def _counted(batches):
    """(post, term, n) of every post in a batch: its distinct tokens with their counts."""
    for whole in batches:
        for lo in range(0, whole.num_rows, BAG_ROWS):
            b = whole.slice(lo, BAG_ROWS)
            sizes = pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = b.column(1).flatten().dictionary_encode()
            code = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            kinds = len(coded.dictionary) + 1
            pairs, n = np.unique(np.repeat(np.arange(len(sizes)), sizes) * kinds + code + 1, return_counts=True)
            real = pairs % kinds > 0
            pairs, n = pairs[real], n[real]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(pairs // kinds)), coded.dictionary.take(pa.array(pairs % kinds - 1)), pa.array(n.astype(float))],
                                             ["post", "term", "n"])


def _bags(numbered: DataFrame, vocabulary: DataFrame | None, n_blocks: int) -> DataFrame:
    """(block, post, term, n): bags of words of ``numbered`` (post, toks), each counted where its post is read."""
    rows = numbered.select("post", "toks").mapInArrow(_counted, "post long, term string, n double")
    if vocabulary is not None:
        rows = rows.join(vocabulary.select("term"), "term", "left_semi")
    return rows.select(F.pmod(F.xxhash64("post"), F.lit(n_blocks)).cast("int").alias("block"), "post", "term", "n")


def _kept(rhos: Sequence[float], end: int) -> list[float]:
    """For each step before ``end``: the share that is left, before step ``end``, of what a term's row had above ``eta`` right after it."""
    out, share = [1.0] * end, 1.0
    for i in range(end - 1, -1, -1):
        out[i] = share
        share *= 1 - rhos[i]
    return out + [share]  # the last one: of the start


def _doubles(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _sent(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows sent to a step: (term, step they were made in, what they had above ``eta``); None if there are none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema("term string, step int, v array<double>").parquet(path)


def _above(sent: DataFrame | None, terms: DataFrame, rhos: Sequence[float], end: int, k: int, seed: int, eta: float) -> DataFrame:
    """``terms`` (each once) with ``d``: what their rows have above ``eta`` before step ``end``."""
    kept = _kept(rhos, end)
    start = F.transform(start_counts(F.col("term"), k, seed), lambda a: (a - F.lit(eta)) * F.lit(kept[-1]))
    if sent is None:
        return terms.withColumn("d", start)
    moved = sent.withColumn("_f", F.get(_doubles(kept), F.col("step"))).select("term", F.transform("v", lambda a: a * F.col("_f")).alias("_d"))
    return terms.join(moved, "term", "left").withColumn("d", F.coalesce("_d", start)).drop("_d")


def fit_topics(tokens_df: DataFrame, tokens: str = "tokens", k: int = DEFAULT_TOPICS, passes: int = 1, chunk_size: int = 10_000,
               seed: int = 7, vocab_size: int | None = None, min_df: float = 1.0, offset: float = 1.0, decay: float = 0.5,
               key: Sequence[str] | None = None) -> TopicModel:
    """topics of the bags of words of every post, in chunks of about ``chunk_size`` posts, each post once a pass.

    The vocabulary holds every distinct token unless ``vocab_size`` keeps the most frequent ones or ``min_df`` asks for more posts.  Step ``t``
    blends a chunk's expected counts, scaled to all posts, into the table with weight ``(offset + t) ** -decay``; a corpus of one
    chunk is replaced whole, which is the batch algorithm.  Posts without a known token change nothing.  An empty corpus gives an empty table.
    ``key``: columns that the model's posts keep, for their mixtures (``topic_mixtures`` without a table).
    """
    numbered = _written(tokens_df.select(*key or [], F.monotonically_increasing_id().alias("post"), F.col(tokens).alias("toks")), "topic-posts")
    counted = numbered.select(F.explode("toks").alias("term"), "post").groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("post").alias("df")) \
        if min_df > 1 else numbered.select(F.explode("toks").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    if min_df > 1:
        counted = counted.where(F.col("df") >= min_df).drop("df")
    if vocab_size is not None:
        counted = counted.orderBy(F.desc("n"), "term").limit(vocab_size)
    words = _written(counted.select("term", "n", start_counts(F.col("term"), k, seed).alias("lam")), "topic-words")
    n_posts = numbered.agg(F.count(F.lit(1))).first()[0]
    chunks = max(1, math.ceil(n_posts / chunk_size))
    n_tokens = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_blocks = chunks * max(1, math.ceil(n_tokens / BLOCK_PAIRS / chunks))
    known = words if vocab_size is not None or min_df > 1 else None
    alpha = eta = 1.0 / k
    if not passes:
        return TopicModel(words, _totals(words, k), k, alpha, eta, [])
    spark = tokens_df.sparkSession
    bags = _by_chunk(_bags(numbered, known, n_blocks).withColumn("chunk", (F.col("block") % chunks).cast("int")).repartition("block"), "topic-bags")
    # of each chunk's terms the blocks that hold them, and the next chunk that does, in this pass or (plus the number of chunks) in the next one
    of_term = Window.partitionBy("term")
    nth = F.floor(F.col("block") / chunks).cast("int")  # blocks of a chunk are numbered 0, 1, ..; each has a bit
    at_word, at_bit = F.floor(nth / 32).cast("int"), nth % 32
    after = F.coalesce(F.lead("chunk").over(of_term.orderBy("chunk")), F.min("chunk").over(of_term) + chunks)
    held = [F.bit_or(F.when(at_word == w, F.call_function("shiftleft", F.lit(1).cast("long"), at_bit)).otherwise(F.lit(0).cast("long"))).alias(f"b{w}")
            for w in range(math.ceil(n_blocks / chunks / 32))]
    nexts = _by_chunk(bags.groupBy("chunk", "term").agg(*held).withColumn("after", after), "topic-next")
    blocks = F.filter(F.transform(F.sequence(F.lit(0), F.lit(n_blocks // chunks - 1)), lambda i: F.when(
        F.get(F.array(*[f"b{w}" for w in range(len(held))]), F.floor(i / 32).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i % 32)) != 0,
        i * chunks + F.col("chunk"))), lambda b: b.isNotNull())
    n_terms, n_steps, root = words.count(), passes * chunks, scratch_dir(spark, "topic-rows")
    rhos = [1.0 if chunks == 1 else (offset + step) ** -decay for step in range(n_steps)]
    totals, bounds, scale = _totals(words, k), [], float(chunks)
    for step, rho in enumerate(rhos):
        c = step % chunks
        seen = [0.0, 0.0] if c == 0 else seen
        held = nexts.where(F.col("chunk") == c).select("term", blocks.alias("blocks"), F.least(F.col("after") + (step - c), F.lit(n_steps)).alias("target"))
        rows = _above(_sent(spark, f"{root}/target={step}"), held, rhos, step, k, seed, eta).persist(StorageLevel.MEMORY_AND_DISK)
        lam = rows.select(F.explode("blocks").alias("at"), F.col("term").alias("word"), F.transform("d", lambda a: a + F.lit(eta)).alias("lam"))
        stats = _chunk_counts(bags.where(F.col("chunk") == c).drop("chunk"), lam, totals, k, alpha)
        sums = {r["none"]: r for r in stats.groupBy(F.col("term").isNull().alias("none")).agg(
            *[F.sum(F.get("v", F.lit(i))).alias(f"v{i}") for i in range(max(k, 2))]).collect()}  # two rows
        if True in sums:
            seen = [a + float(sums[True][f"v{i}"] or 0.0) for i, a in enumerate(seen)]
        blend = F.zip_with("d", "v", lambda a, b: a * F.lit(1 - rho) + F.lit(rho * scale) * b)
        fresh = stats.where(F.col("term").isNotNull()).join(rows, "term").select("term", F.lit(step).alias("step"), blend.alias("v"), "target")
        fresh.repartition("target").write.mode("append").partitionBy("target").parquet(root)
        rows.unpersist()
        own = [sums[False][f"v{i}"] for i in range(k)] if False in sums else [0.0] * k
        totals = [n_terms * eta + (1 - rho) * (t - n_terms * eta) + rho * scale * float(o) for t, o in zip(totals, own)]
        if c == chunks - 1:
            bounds.append(seen[0] / seen[1] if seen[1] else 0.0)
    last = _above(_sent(spark, f"{root}/target={n_steps}"), words.select("term", "n"), rhos, n_steps, k, seed, eta)
    words = _written(last.select("term", "n", F.transform("d", lambda a: a + F.lit(eta)).alias("lam")), "topic-words")
    return TopicModel(words, totals, k, alpha, eta, bounds, (numbered.drop("toks"), bags.drop("chunk")))


def _by_chunk(df: DataFrame, name: str) -> DataFrame:
    """Written with a folder per chunk, so that a step reads its own chunk only."""
    path = scratch_dir(df.sparkSession, name)
    df.write.partitionBy("chunk").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _totals(words: DataFrame, k: int) -> list[float]:
    row = words.agg(*[F.coalesce(F.sum(F.get("lam", F.lit(i))), F.lit(0.0)).alias(f"t{i}") for i in range(k)]).first()
    return [float(v) for v in row]


def _with_rows(bags: DataFrame, words: DataFrame) -> DataFrame:
    """(at, word, lam): the rows of the terms that each block holds."""
    held = bags.select(F.col("block").alias("at"), F.col("term").alias("word")).distinct()
    return held.join(words.select(F.col("term").alias("word"), "lam"), "word")


def _chunk_counts(bags: DataFrame, held: DataFrame, totals: list[float], k: int, alpha: float) -> DataFrame:
    """(term, v): the expected counts of ``bags``; ``held`` has (at, word, lam), see ``_with_rows``."""
    per_block = bags.groupBy("block").cogroup(held.groupBy("at")).applyInArrow(
        _expected_counts(k, alpha, np.array(totals)), "term string, v array<double>")
    sums = per_block.groupBy("term").agg(*[F.sum(F.get("v", F.lit(i))).alias(f"v{i}") for i in range(k)])
    return _written(sums.select("term", F.array(*[f"v{i}" for i in range(k)]).alias("v")), "topic-counts")


def topic_mixtures(model: TopicModel, tokens_df: DataFrame | None = None, tokens: str = "tokens", key: Sequence[str] = KEY) -> DataFrame:
    """(key, theta array<double>): the topic mixture of every row; one without a known token has equal shares.

    Without ``tokens_df`` the rows are those of the fit, whose bags are there already.
    """
    if tokens_df is None:
        numbered, bags = model.seen
    else:
        numbered = _written(tokens_df.select(*key, F.monotonically_increasing_id().alias("post"), F.col(tokens).alias("toks")), "topic-posts")
        n = numbered.agg(F.coalesce(F.sum(F.size("toks")), F.lit(0))).first()[0]
        bags = _written(_bags(numbered, None, max(1, math.ceil(n / BLOCK_PAIRS))).repartition("block"), "topic-bags")
    theta = bags.groupBy("block").cogroup(_with_rows(bags, model.words).groupBy("at")).applyInArrow(
        _mixtures(model.alpha, np.array(model.totals)), "post long, theta array<double>")
    even = F.array(*[F.lit(1.0 / model.k)] * model.k)
    return numbered.join(theta, "post", "left").select(*key, F.coalesce("theta", even).alias("theta"))


def topic_distribution(model: TopicModel, tokens_df: DataFrame | None = None, tokens: str = "tokens", key: Sequence[str] = KEY) -> DataFrame:
    """``(key, topic_id, prob)`` full topic mixture of every post (see ``topic_mixtures``)."""
    return topic_mixtures(model, tokens_df, tokens, key).select(*key, F.posexplode("theta").alias("topic_id", "prob"))


def model_topic_terms(model: TopicModel) -> DataFrame:
    """``(topic_id, term, weight)``: every topic's word distribution over the whole vocabulary."""
    totals = F.array(*[F.lit(max(t, 1e-300)) for t in model.totals])
    return (model.words.select("term", F.posexplode(F.zip_with("lam", totals, lambda a, t: a / t)).alias("topic_id", "weight"))
            .select("topic_id", "term", "weight"))


def model_vocabulary(model: TopicModel, first: int) -> DataFrame:
    """``(term, term_index)`` of the ``first`` most frequent terms, ties by term."""
    spark = model.words.sparkSession
    head = model.words.orderBy(F.desc("n"), "term").limit(first).select("term").collect()  # at most ``first`` terms
    return spark.createDataFrame([(r["term"], i) for i, r in enumerate(head)], "term string, term_index int")


def model_word_weights(model: TopicModel, doc_topics: DataFrame | None = None, theta: DataFrame | None = None, mode: str = "marginal",
                       key: Sequence[str] = KEY) -> DataFrame:
    """F7 on a fitted model: ``(term, weight)``; the word table is neither exploded by topic nor moved."""
    if mode == "positional":
        # A topic id only ever meets the vocabulary index that equals it.
        return topic_word_weights(doc_topics, vocabulary=model_vocabulary(model, model.k), mode="positional", key=key)
    mean = theta.agg(*[F.avg(F.get("theta", F.lit(i))).alias(f"m{i}") for i in range(model.k)]).first()
    share = F.array(*[F.lit(float(m or 0.0) / max(t, 1e-300)) for m, t in zip(mean, model.totals)])
    weight = F.aggregate(F.zip_with("lam", share, lambda a, s: a * s), F.lit(0.0), lambda a, x: a + x)
    return model.words.select("term", weight.alias("weight"))


def topic_word_weights(doc_topics: DataFrame, topic_terms: DataFrame | None = None,
                       vocabulary: DataFrame | None = None, mode: str = "marginal",
                       key: Sequence[str] = KEY) -> DataFrame:
    """``(term, weight)``.

    ``marginal`` (default): weight(w) = Σ_t mean over posts of θ_t · φ_t(w), the expected share
    of word w under the corpus topic mix.  ``positional`` reproduces the reference literally
    (quirk Q5): the word whose vocabulary index equals a topic id gets that topic's probability
    in the last post (largest key).
    """
    if mode == "marginal":
        # doc_topics is dense (every post has every topic), so the mean share is a plain average
        mean_theta = doc_topics.groupBy("topic_id").agg(F.avg("prob").alias("m"))
        # one row per topic: bounded by the topic count
        return (topic_terms.join(F.broadcast(mean_theta), "topic_id")
                .groupBy("term").agg(F.sum(F.col("m") * F.col("weight")).alias("weight")))
    if mode == "positional":
        last = doc_topics.agg(F.max(F.struct(*key)).alias("_k")).select(*[F.col("_k")[c].alias(c) for c in key])
        probs = doc_topics.join(F.broadcast(last), list(key)).select(
            F.col("topic_id").alias("term_index"), F.col("prob").alias("weight"))
        return vocabulary.join(probs, "term_index").select("term", "weight")
    raise ValueError(f"unknown mode {mode!r}")


def topic_doc_weight(tokens_df: DataFrame, weights: DataFrame, tokens: str = "tokens",
                     key: Sequence[str] = KEY, out: str = "topic_weight",
                     max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS, landed: bool = False, unique: bool = False) -> DataFrame:
    """F8: ``(key, topic_weight)`` = Σ over a post's tokens (with repeats) of the word weight.

    ``tokens`` is a column of token arrays, or of texts that hold them joined by a space.
    Unknown words add nothing; posts without any known word get 0.  The weight table is broadcast after a size
    check; a larger one is looked up block by block (``landed``, ``unique`` keys: see ``blocks.look_up``).
    """
    w = weights.select("term", F.col("weight").cast("double")).persist(StorageLevel.MEMORY_AND_DISK)
    if w.count() > max_broadcast_rows:
        table = (w.where(F.col("term").isNotNull() & F.col("weight").isNotNull())
                 .groupBy(F.col("term").alias("_word")).agg(F.sum("weight").alias("weight")))
        return look_up(tokens_df, key, key, F.col(tokens), lambda words: table, lambda f: {out: f.per_group("weight")}, f"`{out}` double", landed, unique)
    listed = F.split(tokens, " ") if tokens_df.schema[tokens].dataType == T.StringType() else F.col(tokens)
    toks = tokens_df.select(*key, F.posexplode_outer(listed).alias("pos", "term"))
    hits = toks.join(F.broadcast(w), "term", "left").where(F.col("weight").isNotNull() | F.col("pos").isNull() | (F.col("pos") == 0))
    return hits.groupBy(*key).agg(F.sum("weight").alias(out)).fillna({out: 0.0})
