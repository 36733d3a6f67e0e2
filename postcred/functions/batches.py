"""T1, F2 and F3 over Arrow batches, for tokens and statistics that are landed with their posts.

Same results as ``functions.text.clean_tokens`` and ``functions.stats.token_entropy`` and ``pmi_mean``.  A batch's tokens are numbered first, so every step of the
cleaning runs once per distinct token, and a post's counts come from the numbers: no strings are sorted and no lambda runs per token.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from postcred.functions.text import DIGITS_ONLY_PATTERN, ENGLISH_STOPWORDS, NON_ALNUM_PATTERN

#: Bytes of text that are cut into tokens at once (a longer text is cut alone).
WORK_BYTES = 4 << 20
_PUNCT_RUN = r"[!-/:-@\[-`{-~]+"


def _slices(texts: pa.Array):
    """Runs of rows with about ``WORK_BYTES`` of text each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + WORK_BYTES, side="right")))
        yield texts.slice(lo, hi - lo)
        lo = hi


def _cleaned(texts: pa.Array, stopwords: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct cleaned tokens, number of each token among them, tokens of each row) of lower-cased texts."""
    lists = pc.utf8_split_whitespace(texts)  # the same characters as functions.text.WHITESPACE_CHARS
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    raw, at = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    bare = pc.replace_substring_regex(raw, _PUNCT_RUN, "")
    keep = pc.and_(pc.and_not(pc.greater(pc.utf8_length(bare), 2), pc.is_in(raw, value_set=stopwords)),
                   pc.invert(pc.or_(pc.match_substring_regex(bare, DIGITS_ONLY_PATTERN), pc.match_substring(bare, "https"))))
    final = pc.replace_substring_regex(bare, NON_ALNUM_PATTERN + "+", "").dictionary_encode()
    kept = keep.to_numpy(zero_copy_only=False)[at]
    row = np.repeat(np.arange(len(sizes)), sizes)[kept]
    return final.dictionary, final.indices.to_numpy(zero_copy_only=False).astype(np.int64)[at[kept]], np.bincount(row, minlength=len(sizes))


def _log2(x: np.ndarray) -> np.ndarray:
    return np.log(x) / np.log(2.0)


def _counts(row: np.ndarray, number: np.ndarray, kinds: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct row and number as one key, count of each, sum of c * log2(c) by row)."""
    key, count = np.unique(row * np.int64(kinds) + number, return_counts=True)
    return key, count, np.bincount(key // max(kinds, 1), weights=count * _log2(count), minlength=rows)


def _entropy(kinds: int, number: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """F2 of each row from its tokens' numbers."""
    _, _, spread = _counts(np.repeat(np.arange(len(sizes)), sizes), number, kinds, len(sizes))
    n = np.maximum(sizes, 1)
    return np.where(sizes > 0, _log2(n) - spread / n + 0.0, 0.0)


def _pmi(kinds: int, number: np.ndarray, sizes: np.ndarray, min_tokens: int) -> np.ndarray:
    """F3 of each row from its tokens' numbers, by the closed form of ``functions.stats.pmi_mean``."""
    rows = len(sizes)
    row = np.repeat(np.arange(rows), sizes)
    key, count, words = _counts(row, number, kinds, rows)
    near = np.flatnonzero(row[1:] == row[:-1])
    pair = pa.array(number[near] * np.int64(kinds) + number[near + 1]).dictionary_encode()
    _, _, pairs = _counts(row[near], pair.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(pair.dictionary), rows)
    out = np.zeros(rows)
    at = np.flatnonzero(sizes >= max(min_tokens, 2))
    end = np.cumsum(sizes)[at]
    of = lambda place: count[np.searchsorted(key, at * np.int64(kinds) + number[place])]
    n = sizes[at]
    num = pairs[at] - 2 * words[at] + _log2(of(end - n)) + _log2(of(end - 1))
    out[at] = num / (n - 1) + 2 * _log2(n) - _log2(n - 1) + 0.0
    return out


def clean_tokens_and_entropy(c, stopwords: Iterable[str] | None = None) -> Column:
    """Text -> struct of ``tokens`` (array<string>, null for a null text) and ``entropy`` (double)."""
    words = pa.array(list(ENGLISH_STOPWORDS if stopwords is None else stopwords), pa.string())

    @F.arrow_udf("struct<tokens:array<string>,entropy:double>")
    def run(texts: pa.Array) -> pa.Array:
        parts = []
        for part in _slices(texts):
            kinds, number, sizes = _cleaned(part, words)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), kinds.take(pa.array(number)), mask=pc.is_null(part))
            parts.append(pa.StructArray.from_arrays([lists, pa.array(_entropy(len(kinds), number, sizes))], ["tokens", "entropy"]))
        return pa.concat_arrays(parts) if parts else pa.nulls(0, pa.struct([("tokens", pa.list_(pa.string())), ("entropy", pa.float64())]))
    return run(F.lower(F.col(c) if isinstance(c, str) else c))


def _joined(kinds: pa.Array, number: np.ndarray, sizes: np.ndarray, mask: pa.Array | None = None) -> pa.Array:
    """The tokens of each row joined by a space."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), kinds.take(pa.array(number)), mask=mask), " ")


def _first_row(parts: list[pa.Array], rows: int) -> pa.Array:
    """The distinct tokens of ``parts``, joined by a space, in the first of ``rows`` rows; the others are null."""
    words = pc.unique(pa.concat_arrays(parts))
    return pa.concat_arrays([_joined(words, np.arange(len(words)), np.array([len(words)])), pa.nulls(rows - 1, pa.string())])


def stored_tokens_and_terms(c: str, stopwords: Iterable[str] | None = None) -> Column:
    """T1 and F2 of a text and T1 of its stored form (T6): text -> struct of ``entropy`` (of the text's tokens), ``ltokens`` (the stored text's tokens,
    joined by a space; null for a null text), ``terms`` and ``lterms``.

    The last two are for whoever needs the distinct tokens of all rows: the first row of each Arrow batch has the distinct tokens of the batch's
    texts and stored texts, joined by a space, all others have null.  So the tokens themselves need not be kept.
    """
    words = pa.array(list(ENGLISH_STOPWORDS if stopwords is None else stopwords), pa.string())
    kind = pa.struct([("entropy", pa.float64()), ("ltokens", pa.string()), ("terms", pa.string()), ("lterms", pa.string())])

    @F.arrow_udf("struct<entropy:double,ltokens:string,terms:string,lterms:string>")
    def run(lowered: pa.Array, fused: pa.Array) -> pa.Array:
        entropies, texts, terms, at = [], [], ([], []), 0
        for part in _slices(lowered):
            rows = len(part)
            stored = pc.coalesce(fused.slice(at, rows), pc.replace_substring(part, "\n", ""))
            at += rows
            kinds, number, sizes = _cleaned(pa.concat_arrays([part, stored]), words)  # one pass over the distinct tokens of both
            own, of_stored = np.split(number, [sizes[:rows].sum()])
            entropies.append(_entropy(len(kinds), own, sizes[:rows]))
            texts.append(_joined(kinds, of_stored, sizes[rows:], pc.is_null(part)))
            for held, numbers in zip(terms, (own, of_stored)):
                held.append(kinds.take(pa.array(np.flatnonzero(np.bincount(numbers, minlength=len(kinds))))))
        if not texts:
            return pa.nulls(0, kind)
        return pa.StructArray.from_arrays([pa.array(np.concatenate(entropies)), pa.concat_arrays(texts), *[_first_row(t, len(lowered)) for t in terms]], fields=list(kind))
    text = F.col(c)
    # Only the small form of a capital sigma depends on what follows it, so only such texts are lowered again after their newlines are gone.
    fused = F.when(F.contains(text, F.lit("\u03a3")), F.lower(F.replace(text, F.lit("\n"), F.lit(""))))
    return run(F.lower(text), fused)


def pmi_of_text(c, stopwords: Iterable[str] | None = None, min_tokens: int = 4) -> Column:
    """F3 of a text's cleaned tokens (double); 0 below ``min_tokens`` of them."""
    words = pa.array(list(ENGLISH_STOPWORDS if stopwords is None else stopwords), pa.string())

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        parts = []
        for part in _slices(texts):
            kinds, number, sizes = _cleaned(part, words)
            parts.append(_pmi(len(kinds), number, sizes, min_tokens))
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))
    return run(F.lower(F.col(c) if isinstance(c, str) else c))
