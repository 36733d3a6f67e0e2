"""Quality rules: repetition coverage from rolling hashes, in numpy.

For each text: the characters inside word n-grams (several lengths) found twice or more, and inside lines
equal to an earlier line, as shares of all word characters.  Words, n-grams and lines are compared by 64-bit
rolling hashes within one text only.  A row never leaves its task; a block of rows is hashed at once, and a
longer text is a block of its own.

Defined results: null or wordless texts have zero counts and shares and fail the base rules.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postcred.llm.common import SPACE, mix64, packed, row_blocks, runs, span_hashes, unpacked, utf8

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: Largest share of word characters inside repeated n-grams of each length, and inside repeated lines.
GRAM_LIMITS = {2: 0.70, 5: 0.40, 10: 0.30}
LINE_LIMIT = 0.30
MIN_WORDS = 50
WINDOW = 3

_GOLD = np.uint64(0x9E3779B97F4A7C15)
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _twice(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found twice or more, not the first of its kind) for each key; the first is the one furthest left."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = s[1:] == s[:-1]
    later, any_ = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    any_[order[1:]] = same
    any_[order[:-1]] |= same
    return any_, later


def _grams(words: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n words from each position, and whether they all belong to one text."""
    m = max(0, len(words) - n + 1)
    h = np.zeros(m, np.uint64)
    for i in range(n):
        h = mix64(h * _GOLD + words[i:i + m])
    return h, doc[:m] == doc[n - 1:n - 1 + m] if m else np.zeros(0, bool)


def _covered(words: np.ndarray, doc: np.ndarray, salt: np.ndarray, n: int) -> np.ndarray:
    """Words inside an n-word window that its text holds twice or more."""
    out = np.zeros(len(words) + 1, np.int64)
    h, whole = _grams(words, doc, n)
    at = np.flatnonzero(whole)
    again, _ = _twice(h[at] ^ salt[doc[at]])
    hit = at[again]
    np.add.at(out, hit, 1)
    np.add.at(out, hit + n, -1)
    return np.cumsum(out[:-1]) > 0


def measure(data: np.ndarray, offs: np.ndarray, lengths=tuple(GRAM_LIMITS)) -> dict[str, np.ndarray]:
    """The counts of a block of texts, and the covered characters by n-gram length (``gram_n``) and lines."""
    n_docs, base = len(offs) - 1, offs[0]
    cuts, data = offs - base, data[offs[0]:offs[-1]]
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    salt = mix64(np.arange(1, n_docs + 1, dtype=np.uint64) * _GOLD)

    def per_doc(doc, weights=None):
        return np.bincount(doc, weights=weights, minlength=n_docs).astype(np.int64)

    filled = ~SPACE[data]
    s, e = runs(filled, cuts)
    doc = np.searchsorted(cuts, s, side="right") - 1
    words, size = span_hashes(data, s, e), chars[e] - chars[s]
    out = {"n_words": per_doc(doc), "word_chars": per_doc(doc, size),
           "n_symbols": np.add.reduceat(np.append(SYMBOLS[data], False).astype(np.int64), np.minimum(cuts[:-1], len(data)))
           * (np.diff(cuts) > 0),
           "n_repeat_words": per_doc(doc[_covered(words, doc, salt, WINDOW)])}
    for n in lengths:
        hit = _covered(words, doc, salt, n)
        out[f"gram_{n}"] = per_doc(doc[hit], size[hit])
    feeds = np.flatnonzero(data == 10)
    ls = np.sort(np.concatenate([cuts[:-1], feeds + 1]))
    le = np.sort(np.concatenate([cuts[1:], feeds]))
    ld = np.sort(np.concatenate([np.arange(n_docs), np.searchsorted(cuts, feeds, side="right") - 1]))
    ink = np.concatenate([[0], np.cumsum(filled)])
    has = ink[le] > ink[ls]
    ls, le, ld = ls[has], le[has], ld[has]
    _, later = _twice(span_hashes(data, ls, le) ^ salt[ld])
    out["n_dup_lines"] = per_doc(ld[later])
    out["line_chars"] = per_doc(ld[later], _chars_in(filled & ((data & 0xC0) != 0x80), ls[later], le[later]))
    return out


def _chars_in(ink: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(ink)])
    return c[e] - c[s]


def judge(m: dict[str, np.ndarray], gram_limits=None, line_limit=LINE_LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept)."""
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    good = ~failed & (m["line_chars"] <= line_limit * m["word_chars"])
    for n, most in (gram_limits or GRAM_LIMITS).items():
        good &= m[f"gram_{n}"] <= most * m["word_chars"]
    return failed, good


def quality_rows(base: DataFrame, gram_limits=None, line_limit=LINE_LIMIT) -> DataFrame:
    """The measures and verdicts of a ``packed`` table, one row for each of its rows, beside (id, rk)."""
    limits = dict(gram_limits or GRAM_LIMITS)
    names = COUNTS + ["line_chars", *[f"gram_{n}" for n in limits]]
    schema = "id long, rk long, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, kept boolean"

    def run(batches):
        for b in batches:
            data, offs = utf8(b.column(2))
            for lo, hi in row_blocks(offs):
                m = measure(data, offs[lo:hi + 1], tuple(limits))
                failed, kept = judge(m, limits, line_limit)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), *[pa.array(m[n]) for n in names],
                     pa.array(failed), pa.array(kept)], ["id", "rk", *names, "base_failed", "kept"])
    return base.select(F.col("id").cast("long").alias("id"), "rk", "text").mapInArrow(run, schema)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """``docs`` without the rows that the rules reject.  The verdict depends on the text alone."""
    verdict = F.arrow_udf(_kept_udf(**limits), "boolean")
    return docs.where(verdict(F.coalesce(F.col(text_col), F.lit(""))))


def _kept_udf(gram_limits=None, line_limit=LINE_LIMIT):
    limits = dict(gram_limits or GRAM_LIMITS)

    def kept(texts: pa.Array) -> pa.Array:
        # Bytes are measured where they lie: no Python string is made of a text.
        data, offs = utf8(texts)
        parts = [judge(measure(data, offs[lo:hi + 1], tuple(limits)), limits, line_limit)[1] for lo, hi in row_blocks(offs)]
        return pa.array(np.concatenate(parts) if parts else np.empty(0, bool))
    return kept


def op6_quality_rules(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_rows(packed(docs, "doc_id", "text")).select(
        F.col("id").alias("doc_id"), *COUNTS, "base_failed", "kept")
