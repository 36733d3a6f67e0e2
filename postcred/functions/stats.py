"""Row-local text statistics over a token array (F2 entropy, F3 bigram PMI).

A post is one row, so its word and bigram counts never need a shuffle: the token array is
sorted inside the row and run lengths are read off the sorted array in one ``aggregate`` pass.

Rule kept throughout: lambda bodies only reference their own variables.  An outer expression
used inside a lambda is re-evaluated for every element, which turns O(n) into O(n^2).  Callers
therefore materialise the token array as a column first (see ``operators.text.with_tokens``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _clog2c(r: Column) -> Column:
    return F.when(r > 0, r * F.log2(r)).otherwise(F.lit(0.0))


def sum_clog2c_sorted(sorted_arr) -> Column:
    """Σ c·log2(c) over the run lengths c of an already sorted array (0 when empty / NULL).

    One pass with a (previous value, current run, running sum) accumulator.
    """
    s = _col(sorted_arr)
    elem_type = "string"
    init = F.struct(
        F.lit(None).cast(elem_type).alias("p"), F.lit(0).cast("long").alias("r"),
        F.lit(0.0).alias("s"),
    )

    def merge(acc, x):
        same = (acc["r"] > 0) & (acc["p"] == x)
        return F.when(same, F.struct(acc["p"].alias("p"), (acc["r"] + 1).alias("r"), acc["s"].alias("s"))) \
            .otherwise(F.struct(x.alias("p"), F.lit(1).cast("long").alias("r"),
                                (acc["s"] + _clog2c(acc["r"])).alias("s")))

    return F.coalesce(F.aggregate(s, init, merge, lambda acc: acc["s"] + _clog2c(acc["r"])), F.lit(0.0))


def sorted_pair_keys(tokens) -> Column:
    """Sorted bigram keys of a token array (tokens hold only letters / digits, so a space is a safe
    separator); NULL when fewer than two tokens."""
    t = _col(tokens)
    n = F.size(t)
    pairs = F.zip_with(F.slice(t, 1, n - 1), F.slice(t, 2, n - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(n > 1, F.sort_array(pairs))


def token_entropy(tokens, sorted_tokens) -> Column:
    """F2: Shannon entropy (bits) of the token distribution; 0 for no tokens, never -0.0.

    ``H = log2(n) - Σ c·log2(c) / n`` with c the count of each distinct token.
    """
    n = F.size(_col(tokens))
    h = F.log2(n) - sum_clog2c_sorted(sorted_tokens) / n
    return F.when(n > 0, h + F.lit(0.0)).otherwise(F.lit(0.0))


def pmi_mean(tokens, sorted_tokens, sorted_pairs, min_tokens: int = 4) -> Column:
    """mean over bigram occurrences of log2(P(w1 w2) / (P(w1) P(w2))); 0 below ``min_tokens``.

    P(w) = c_w / n, P(w1 w2) = c_12 / (n-1).  Summed over occurrences this is
    ``(Σ_b c_b log2 c_b − 2 Σ_w c_w log2 c_w + log2 c(first) + log2 c(last)) / (n−1)
    + 2 log2 n − log2(n−1)``, so only the two count distributions are needed.
    """
    t = _col(tokens)
    n = F.size(t)
    c_first = n - F.size(F.array_remove(t, F.get(t, 0)))
    c_last = n - F.size(F.array_remove(t, F.get(t, n - 1)))
    num = (
        sum_clog2c_sorted(sorted_pairs)
        - 2 * sum_clog2c_sorted(sorted_tokens)
        + F.log2(c_first)
        + F.log2(c_last)
    )
    value = num / (n - 1) + 2 * F.log2(n) - F.log2(n - 1)
    return F.when(n >= min_tokens, value + F.lit(0.0)).otherwise(F.lit(0.0))
