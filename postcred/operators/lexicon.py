"""Lexicon scoring (L1-L4) as joins against lexicon tables.

The per-row libraries of the reference (valence list, subjectivity list, category lists) are
re-expressed as tables.  A lexicon whose size is checked to be small is broadcast: posts are exploded to words, joined to it
and aggregated back per post.  Only lexicon *hits* travel past the
join, plus one marker row per post so that posts without any hit still get a (zero) score
without a join back.  The aggregations group by the post key; when the input is the deduplicated
``posts`` frame that grouping is already satisfied by its partitioning, so no exchange is added.
A larger lexicon is looked up block by block (``operators.blocks``): the distinct terms of a block of posts move, never its single words.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postcred.functions.features import DECEPTION_CATEGORIES, deception_index
from postcred.functions.text import lexicon_words, split_ws
from postcred.operators.blocks import Found, look_up, sums
from postcred.operators.joins import DEFAULT_MAX_BROADCAST_ROWS
from postcred.schemas import KEY


def _is_marker(pos_col: str) -> F.Column:
    """The first (or the only, NULL) exploded row of a post: kept even without a lexicon hit so
    every post reaches the aggregation and no join back to the posts is needed."""
    return F.col(pos_col).isNull() | (F.col(pos_col) == 0)


def lexicon_sentiment(posts: DataFrame, lexicon: DataFrame, text_col: str = "text",
                      key: Sequence[str] = KEY,
                      max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS, landed: bool = False, unique: bool = False) -> DataFrame:
    """L1: ``(key, positive, negative, neutral)``.

    Each whitespace token scores the sum of the valences of the words inside it (so ``good/bad``
    nets to 0) plus the valence of the whole token when the lexicon lists it as an emoticon.
    ``positive`` sums the positive token scores, ``negative`` the negative ones; ``neutral`` is
    always 0, as in the reference (quirk Q4).  ``lexicon``: ``(term, score, kind)``.  ``landed``, ``unique`` (keys): see ``blocks.look_up``.
    """
    lex = lexicon.select("kind", "term", F.col("score").cast("long").alias("score")).persist(StorageLevel.MEMORY_AND_DISK)
    if lex.count() > max_broadcast_rows:
        return _sentiment_in_blocks(posts, lex, text_col, key, landed, unique)
    # One explode: a row per word of a raw token, plus one for the token itself where it may be an emoticon (it has a non-word sign).
    parts = F.transform(split_ws(text_col), lambda t, i: F.transform(
        F.concat(F.array(F.struct(F.lit("emoticon").alias("kind"), t.alias("term"))),
                 F.transform(lexicon_words(t), lambda w: F.struct(F.lit("word").alias("kind"), w.alias("term")))),
        lambda p: F.struct(i.alias("pos"), p["kind"].alias("kind"), p["term"].alias("term"))))
    plain = F.filter(F.flatten(parts), lambda p: (p["kind"] == "word") | p["term"].rlike(EMOTICON_SIGN))
    rows = posts.select(*key, F.posexplode_outer(plain).alias("at", "p")).select(*key, "at", F.col("p.pos").alias("pos"), F.col("p.kind").alias("kind"), F.col("p.term").alias("term"))
    j = rows.join(F.broadcast(lex), ["kind", "term"], "left")
    hits = j.where((F.coalesce("score", F.lit(0)) != 0) | _is_marker("at"))
    per_token = hits.groupBy(*key, "pos").agg(F.sum("score").alias("s"))
    per_post = per_token.groupBy(*key).agg(
        F.coalesce(F.sum(F.greatest(F.col("s"), F.lit(0))), F.lit(0)).alias("positive"),
        F.coalesce(F.sum(F.least(F.col("s"), F.lit(0))), F.lit(0)).alias("negative"),
    )
    return per_post.select(*key, "positive", "negative", F.lit(0).cast("long").alias("neutral"))


def _sentiment_in_blocks(posts: DataFrame, lex: DataFrame, text_col: str, key: Sequence[str], landed: bool, unique: bool) -> DataFrame:
    """L1 with a large lexicon: the valence of each distinct raw token, from its words and, where it may be an emoticon, itself."""
    part = lambda kind, t: F.struct(F.lit(kind).alias("kind"), t.alias("term"))
    word = F.col("_word")
    parts = F.concat(F.transform(lexicon_words(word), lambda w: part("word", w)),
                     F.when(word.rlike(EMOTICON_SIGN), F.array(part("emoticon", word))).otherwise(F.array().cast("array<struct<kind:string,term:string>>")))

    def score(f: Found) -> dict:
        s, group = f.values["score"], f.group
        if f.repeated and len(s):  # tokens at one place of a repeated post are one token
            pairs, token = np.unique(np.stack([f.group, f.place]), axis=1, return_inverse=True)
            s, group = sums(s, token.reshape(-1), pairs.shape[1]), pairs[0]
        return {"positive": sums(np.maximum(s, 0), group, f.groups), "negative": sums(np.minimum(s, 0), group, f.groups)}
    out = look_up(posts, key, key, F.col(text_col), lambda words: _summed(words, parts, lex, ["kind", "term"], ["score"]), score, "positive long, negative long", landed, unique)
    return out.select(*key, "positive", "negative", F.lit(0).cast("long").alias("neutral"))


def _summed(words: DataFrame, parts: Column, entries: DataFrame, on: Sequence[str], values: Sequence[str]) -> DataFrame:
    """``(_word, values...)``: the sums over the entries that a token's parts meet, for tokens that meet any; parts that no entry has stay."""
    rows = words.select("_word", F.explode(parts).alias("_p")).select("_word", *([F.col("_p")[c].alias(c) for c in on] if len(on) > 1 else [F.col("_p").alias(on[0])]))
    return (rows.where(lexicon_filter(entries, on)).join(entries, list(on)).groupBy("_word")
            .agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in values]))


#: A raw token can only be listed as an emoticon if it is not a plain word.
EMOTICON_SIGN = r"[^\p{L}\p{N}_']"
#: 64-bit words of the prefilter (8 MB) that terms are tested by before the join with a large lexicon moves any of them.
FILTER_WORDS = 1 << 20


def lexicon_filter(lexicon: DataFrame, on: Sequence[str]):
    """A test over ``on`` (a Bloom filter) that holds for every entry of the lexicon and for few other values.

    The entries' hashes are or-ed into words on the executors; the filter has a fixed size, so a lexicon of any size gets one.
    """
    h = F.xxhash64(*on)
    bits = F.expr("shiftleft(1L, cast(pmod(h, 64) as int)) | shiftleft(1L, cast(pmod(shiftright(h, 6), 64) as int))")
    words = (lexicon.select(h.alias("h")).select(F.pmod(F.shiftright("h", 12), F.lit(FILTER_WORDS)).cast("int").alias("at"), bits.alias("bits"))
             .groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow())  # at most FILTER_WORDS rows
    table = np.zeros(FILTER_WORDS, np.uint64)
    table[words.column("at").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    shared = lexicon.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def might_hold(h: pd.Series) -> pd.Series:
        x = h.to_numpy(np.int64)
        mask = (np.uint64(1) << (x % 64).astype(np.uint64)) | (np.uint64(1) << ((x >> 6) % 64).astype(np.uint64))
        return pd.Series((shared.value[(x >> 12) % FILTER_WORDS] & mask) == mask)
    return might_hold(h)


def lexicon_subjectivity(posts: DataFrame, lexicon: DataFrame, text_col: str = "text_stripped",
                         key: Sequence[str] = KEY,
                         max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """L2: ``(key, subjectivity)`` = mean subjectivity of the words found in the lexicon, 0 if none.

    ``lexicon``: ``(term, subjectivity)`` with values in [0, 1].
    """
    lex = lexicon.select("term", F.col("subjectivity").cast("double")).persist(StorageLevel.MEMORY_AND_DISK)
    if lex.count() > max_broadcast_rows:
        entries = lex.select("term", F.col("subjectivity").alias("s"), F.col("subjectivity").isNotNull().cast("long").alias("n"))
        d = look_up(posts, key, key, F.col(text_col), lambda words: _summed(words, lexicon_words("_word"), entries, ["term"], ["s", "n"]),
                    lambda f: {v: f.per_group(v) for v in ("s", "n")}, "s double, n long")
        return d.select(*key, F.coalesce(F.try_divide("s", "n"), F.lit(0.0)).alias("subjectivity"))
    words = posts.select(*key, F.posexplode_outer(lexicon_words(text_col)).alias("pos", "term"))
    hits = words.join(F.broadcast(lex), "term", "left").where(F.col("subjectivity").isNotNull() | _is_marker("pos"))
    per_post = hits.groupBy(*key).agg(F.avg("subjectivity").alias("subjectivity"))
    return per_post.fillna({"subjectivity": 0.0})


def category_rates(posts: DataFrame, lexicon: DataFrame, text_col: str = "text_stripped",
                   key: Sequence[str] = KEY, categories: Sequence[str] = DECEPTION_CATEGORIES,
                   max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """L3: ``(key, <one rate column per category>)``: matching words / all words of the post.

    ``lexicon``: ``(category, term)``; a term may sit in several categories.  The pivot runs over
    the fixed category list, so it is a single aggregation and missing categories read 0.
    """
    cats = list(categories)
    lex = lexicon.where(F.col("category").isin(cats)).select("category", "term").persist(StorageLevel.MEMORY_AND_DISK)
    if lex.count() > max_broadcast_rows:
        held = [f"_c{i}" for i in range(len(cats))]
        entries = lex.select("term", *[(F.col("category") == c).cast("long").alias(h) for c, h in zip(cats, held)])
        counts = look_up(posts.select(*key, F.size(lexicon_words(text_col)).alias("n_words"), text_col), [*key, "n_words"], key, F.col(text_col),
                         lambda words: _summed(words, lexicon_words("_word"), entries, ["term"], held),
                         lambda f: {h: f.per_group(h) for h in held}, ", ".join(f"{h} long" for h in held))
        return counts.select(*key, *[_rate(h).alias(c) for c, h in zip(cats, held)])
    w = posts.select(*key, lexicon_words(text_col).alias("_w"))
    words = w.select(*key, F.size("_w").alias("n_words"), F.posexplode_outer("_w").alias("pos", "term"))
    hits = words.join(F.broadcast(lex), "term", "left").where(F.col("category").isNotNull() | _is_marker("pos"))
    counts = hits.groupBy(*key, "n_words").pivot("category", cats).agg(F.count(F.lit(1)))
    return counts.select(*key, *[_rate(c).alias(c) for c in cats])


def _rate(c: str) -> Column:
    return F.coalesce(F.try_divide(F.col(c), F.col("n_words")), F.lit(0.0))


def with_deception_index(rates: DataFrame, out: str = "deception_index") -> DataFrame:
    """L4: add the deception index column computed from the category rate columns."""
    idx = deception_index()
    return rates.withColumn(out, idx)


def comparison_scores(posts: DataFrame, subj_lexicon: DataFrame, cat_lexicon: DataFrame,
                      text_col: str = "text_stripped", key: Sequence[str] = KEY,
                      carry: Sequence[str] = (), categories: Sequence[str] = DECEPTION_CATEGORIES,
                      max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS, landed: bool = False) -> DataFrame:
    """L2 + L3 + L4 in one pass: ``(key, carry..., subjectivity, <category rates>, deception_index)``.

    The stripped text is exploded to words once; both lexicons are joined to the same rows.  The
    category lexicon is first folded to one row per term (its category list), so a term in several
    categories does not duplicate the word row that the subjectivity mean is taken over.
    ``carry`` names per-post columns (e.g. ``pmi``) passed through the single aggregation.  ``landed``: see ``blocks.look_up``.
    """
    cats = list(categories)
    subj = subj_lexicon.select("term", F.col("subjectivity").cast("double")).persist(StorageLevel.MEMORY_AND_DISK)
    per_term = (cat_lexicon.where(F.col("category").isin(cats))
                .groupBy("term").agg(F.collect_set("category").alias("_cats"))).persist(StorageLevel.MEMORY_AND_DISK)    # bounded by the lexicon
    if max(subj.count(), per_term.count()) > max_broadcast_rows:
        return with_deception_index(_scores_in_blocks(posts, text_col, subj, per_term, key, carry, cats, landed))
    w = posts.select(*key, *carry, lexicon_words(text_col).alias("_w"))
    words = w.select(*key, *carry, F.size("_w").alias("n_words"), F.posexplode_outer("_w").alias("pos", "term"))
    j = words.join(F.broadcast(subj), "term", "left").join(F.broadcast(per_term), "term", "left")
    hits = j.where(F.col("subjectivity").isNotNull() | F.col("_cats").isNotNull() | _is_marker("pos"))
    counts = [F.sum(F.when(F.array_contains("_cats", c), 1).otherwise(0)).alias(c) for c in cats]
    agg = hits.groupBy(*key, *carry, "n_words").agg(F.avg("subjectivity").alias("subjectivity"), *counts)
    out = agg.select(*key, *carry, F.coalesce("subjectivity", F.lit(0.0)).alias("subjectivity"),
                     *[_rate(c).alias(c) for c in cats])
    return with_deception_index(out)


def _scores_in_blocks(posts: DataFrame, text_col: str, subj: DataFrame, per_term: DataFrame, key: Sequence[str], carry: Sequence[str],
                      cats: Sequence[str], landed: bool) -> DataFrame:
    """L2 + L3 with a large lexicon: both are first joined to one table with a row per term."""
    held = [f"_c{i}" for i in range(len(cats))]
    one = subj.groupBy("term").agg(F.sum("subjectivity").alias("s"), F.count("subjectivity").alias("n"), F.count(F.lit(1)).alias("times"))
    both = one.join(per_term, "term", "full").select(
        "term", "s", "n",
        *[(F.coalesce(F.array_contains("_cats", c).cast("long"), F.lit(0)) * F.coalesce("times", F.lit(1))).alias(h) for c, h in zip(cats, held)]).persist(StorageLevel.MEMORY_AND_DISK)
    sums_of = ["s", "n", *held]
    d = look_up(posts.select(*key, *carry, F.size(lexicon_words(text_col)).alias("n_words"), text_col), [*key, *carry, "n_words"], key, F.col(text_col),
                lambda words: _summed(words, lexicon_words("_word"), both, ["term"], sums_of),
                lambda f: {v: f.per_group(v) for v in sums_of}, "s double, n long, " + ", ".join(f"{h} long" for h in held), landed)
    return d.select(*key, *carry, F.coalesce(F.try_divide("s", "n"), F.lit(0.0)).alias("subjectivity"), *[_rate(h).alias(c) for c, h in zip(cats, held)])
