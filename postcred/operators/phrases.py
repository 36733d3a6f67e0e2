"""Lexicons with phrases and emoticons (L1): longest match by a trie over token sequences.

Entries of one or more tokens (``not bad``, ``:-)``, ``good``) are compiled once into a trie whose edges are tokens; the trie goes to the
tasks as one object, and a post is matched from left to right: at each token the longest entry that begins there
scores and is skipped over, else one token is skipped.  Matching runs in Arrow batches, nothing is shuffled.

A lexicon of more than ``DEFAULT_MAX_BROADCAST_ROWS`` entries is never collected: posts are dealt into blocks, a block gets the entries that begin with one
of its words (longer ones: with two words that follow each other in it), and its trie is made of those.  No other entry can match there.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postcred.functions.text import lexicon_words, split_ws
from postcred.operators.blocks import written
from postcred.operators.joins import DEFAULT_MAX_BROADCAST_ROWS
from postcred.operators.lexicon import lexicon_filter
from postcred.schemas import KEY

#: Entries that ``compile_lexicon`` makes a trie of at most.
MAX_ENTRIES = 1_000_000
#: Bytes of text in a block (about), and posts of a block that are matched at once; a post is never cut.
BLOCK_BYTES, WORK_POSTS = 4 << 20, 64


class TokenTrie:
    """Token sequences with a score each; nodes are numbers, so the whole is two flat dictionaries."""

    def __init__(self, entries: Iterable[tuple[Sequence[str], int]]):
        self.edges: dict[tuple[int, str], int] = {}
        self.score: dict[int, int] = {}
        for tokens, score in entries:
            node = 0
            for t in tokens:
                node = self.edges.setdefault((node, t), len(self.edges) + 1)
            if node:
                self.score[node] = int(score)

    def longest(self, tokens: Sequence[str], at: int) -> tuple[int, int] | None:
        """(end, score) of the longest entry that begins at a token."""
        node, found = 0, None
        for i in range(at, len(tokens)):
            node = self.edges.get((node, tokens[i]))
            if node is None:
                break
            if node in self.score:
                found = (i + 1, self.score[node])
        return found

    def matches(self, tokens: Sequence[str]) -> list[tuple[int, int, int]]:
        """(start, end, score) from left to right, longest first, without overlaps."""
        out, at = [], 0
        while at < len(tokens):
            hit = self.longest(tokens, at)
            if hit is None:
                at += 1
            else:
                out.append((at, *hit))
                at = hit[0]
        return out


def lexicon_entries(lexicon: DataFrame) -> DataFrame:
    """(tokens, score) of a lexicon ``(term, score, kind)``: words and phrases by their lower-cased words, emoticons by the whole raw token.

    An entry given twice keeps its smallest score; entries without a token or a score are left out.
    """
    words = F.when(F.col("kind") == "emoticon", F.array(F.concat(F.lit("\0"), F.trim("term")))).otherwise(lexicon_words("term"))
    return (lexicon.where(F.col("term").isNotNull() & F.col("score").isNotNull()).select(words.alias("tokens"), "score")
            .where(F.size("tokens") > 0).groupBy("tokens").agg(F.min("score").alias("score")))


def compile_lexicon(lexicon: DataFrame, max_entries: int = MAX_ENTRIES) -> TokenTrie:
    """Trie of a lexicon (see ``lexicon_entries``)."""
    return _trie(lexicon_entries(lexicon), max_entries)


def _trie(entries: DataFrame, max_entries: int) -> TokenTrie:
    found = entries.limit(max_entries + 1).collect()
    if len(found) > max_entries:
        raise ValueError(f"more than {max_entries} entries")
    return TokenTrie(sorted((tuple(r["tokens"]), r["score"]) for r in found))


def _raw_tokens(text: Column) -> Column:
    """Raw tokens of a text, each with the entry it would be as an emoticon and its words."""
    return F.transform(split_ws(text), lambda t: F.struct(F.concat(F.lit("\0"), t).alias("raw"), lexicon_words(t).alias("words")))


def _emoticons(trie: TokenTrie) -> set[str]:
    return {tok for (node, tok) in trie.edges if node == 0 and tok.startswith("\0")}


def _scores(trie: TokenTrie, emoticons: set[str], posts: Iterable) -> list[pa.Array]:
    """Columns positive, negative, neutral, n_phrases of posts given as raw tokens."""
    out: list[tuple[int, int, int]] = []
    for toks in posts:
        seq: list[str] = []
        for x in toks or []:
            if x["raw"] in emoticons:
                seq.append(x["raw"])
            else:
                seq.extend(x["words"])
        hits = trie.matches(seq)
        out.append((sum(s for _, _, s in hits if s > 0), sum(s for _, _, s in hits if s < 0), sum(e - a > 1 for a, e, _ in hits)))
    positive, negative, phrases = ([r[i] for r in out] for i in range(3))
    return [pa.array(v, pa.int64()) for v in (positive, negative, [0] * len(out), phrases)]


_OUT = ["positive", "negative", "neutral", "n_phrases"]


def phrase_sentiment(posts: DataFrame, lexicon: DataFrame, text_col: str = "text", key: Sequence[str] = KEY,
                     max_entries: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """``(key, positive, negative, neutral, n_phrases)``: sums of the positive and of the negative scores of the matches.

    A raw token that is an emoticon scores as a whole; the other tokens give their lower-cased words, and entries match runs of words
    that no emoticon breaks.  ``n_phrases`` counts matches of two words or more; ``neutral`` is 0, as in ``lexicon_sentiment``.  A null
    text has no match.  A lexicon of more than ``max_entries`` entries is matched block by block.
    """
    given = posts.schema[text_col]
    text = F.coalesce(F.col(text_col), F.lit("")) if given.nullable else F.col(text_col)
    types = ", ".join([f"{c} {posts.schema[c].dataType.simpleString()}" for c in key] + [f"{c} long" for c in _OUT])
    entries = written(lexicon_entries(lexicon), "phrase-entries")
    if entries.count() > max_entries:
        return _phrases_in_blocks(posts.select(*key, text.alias("_text")), entries, key, types)
    trie = posts.sparkSession.sparkContext.broadcast(_trie(entries, max_entries))
    n = len(key)

    def run(batches):
        emoticons = _emoticons(trie.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(n)], *_scores(trie.value, emoticons, b.column(n).to_pylist())], [*key, *_OUT])
    return posts.select(*key, _raw_tokens(text).alias("toks")).mapInArrow(run, types)


def _phrases_in_blocks(posts: DataFrame, entries: DataFrame, key: Sequence[str], types: str) -> DataFrame:
    """``phrase_sentiment`` of (key, _text) with a written lexicon of any size; what begins an entry decides which blocks get it."""
    rows = written(posts.withColumn("_row", F.monotonically_increasing_id()), "phrase-posts")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("_text").cast("long")), F.lit(0))).first()[0]
    at = F.pmod(F.xxhash64("_row"), F.lit(max(1, math.ceil(size / BLOCK_BYTES)))).cast("int")
    toks = rows.select(*key, at.alias("_at"), _raw_tokens(F.col("_text")).alias("toks"))
    words = F.flatten(F.transform("toks", lambda t: t["words"]))
    pairs = F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    begins = F.array_distinct(F.concat("w", pairs, F.transform("toks", lambda t: t["raw"])))
    starts = entries.withColumn("begin", F.array_join(F.slice("tokens", 1, 2), " "))
    held = toks.withColumn("w", words).select(F.col("_at").alias("_block"), F.explode(begins).alias("begin"))
    held = held.where(lexicon_filter(starts, ["begin"])).distinct().join(starts, "begin").select("_block", "tokens", "score")
    n = len(key)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        trie = TokenTrie(zip(right.column("tokens").to_pylist(), right.column("score").to_pylist()))
        emoticons, parts = _emoticons(trie), []
        for lo in range(0, left.num_rows, WORK_POSTS):
            parts.append(pa.Table.from_arrays(_scores(trie, emoticons, left.column("toks").slice(lo, WORK_POSTS).to_pylist()), _OUT))
        found = pa.concat_tables(parts) if parts else pa.table({c: pa.array([], pa.int64()) for c in _OUT})
        return pa.Table.from_arrays([*[left.column(i) for i in range(n)], *found.columns], [*key, *_OUT])
    return toks.groupBy("_at").cogroup(held.groupBy("_block")).applyInArrow(run, types)
