"""C-means stop rule at any size, and matching of two clusterings by brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from postcred.operators import cluster as CL


def blobs(spark, n):
    d = spark.range(n).select(F.concat(F.lit("p"), "id").alias("screen_name"), F.lit("t").alias("created_at"), (F.col("id") % 3).alias("c"),
                              *[(F.pmod(F.xxhash64("id", F.lit(j)), F.lit(1000)) / 500.0 - 1.0).alias(f"e{j}") for j in range(2)])
    return d.select("screen_name", "created_at", (F.col("c") * 4 + F.col("e0")).alias("a"), (F.when(F.col("c") == 1, 5.0).otherwise(0.0) + F.col("e1")).alias("b")).persist()


def test_iterations_do_not_grow_with_the_rows(spark):
    small = CL.fuzzy_cmeans_fit(blobs(spark, 1000), 3, ["a", "b"], seed=2)
    large = CL.fuzzy_cmeans_fit(blobs(spark, 40_000), 3, ["a", "b"], seed=2, warm_rows=None)
    absolute = CL.fuzzy_cmeans_fit(blobs(spark, 40_000), 3, ["a", "b"], seed=2, warm_rows=None, per_row=False)
    assert small.converged and large.converged and abs(large.iterations - small.iterations) <= 2 and absolute.iterations >= large.iterations


def test_warm_start_ends_where_the_long_run_does(spark):
    data = blobs(spark, 30_000)
    long = CL.fuzzy_cmeans_fit(data, 3, ["a", "b"], seed=4, error=1e-7, warm_rows=None)
    warm = CL.fuzzy_cmeans_fit(data, 3, ["a", "b"], seed=4, warm_rows=2000)
    cold = CL.fuzzy_cmeans_fit(data, 3, ["a", "b"], seed=4, warm_rows=None)
    assert warm.converged and warm.iterations < cold.iterations
    assert all(abs(x - y) < 1e-3 for p, q in zip(warm.centers, long.centers) for x, y in zip(p, q))


def test_one_step_is_a_weighted_mean(spark):
    rows = [("a", "t", 0.0, 1.0), ("b", "t", 2.0, 0.0), ("c", "t", 5.0, 5.0)]
    df = spark.createDataFrame(rows, "screen_name string, created_at string, a double, b double")
    centers = [[0.5, 0.5], [4.0, 4.0]]
    got = CL.cmeans_step(df, centers, ["a", "b"])
    for j in range(2):
        num, den = [0.0, 0.0], 0.0
        for _, _, x, y in rows:
            inv = [1 / ((x - p) ** 2 + (y - q) ** 2) for p, q in centers]
            w = (inv[j] / sum(inv)) ** 2
            num, den = [num[0] + w * x, num[1] + w * y], den + w
        assert got[j] == pytest.approx([v / den for v in num])


@pytest.mark.parametrize("rows, cols", [(1, 1), (3, 3), (4, 4), (5, 5), (2, 4), (4, 2), (6, 6)])
def test_assignment_by_brute_force(rows, cols):
    rng = random.Random(rows * 10 + cols)
    for _ in range(40):
        gain = [[rng.randint(0, 9) for _ in range(cols)] for _ in range(rows)]
        got = CL.best_assignment(gain)
        used = [j for j in got if j >= 0]
        assert len(used) == len(set(used)) == min(rows, cols)
        wide = [r + [0] * max(0, rows - cols) for r in gain]
        best = max(sum(wide[i][p[i]] for i in range(rows)) for p in itertools.permutations(range(len(wide[0])), rows))
        assert sum(gain[i][j] for i, j in enumerate(got) if j >= 0) == best


def test_adjusted_rand_by_all_pairs():
    rng = random.Random(3)
    for _ in range(30):
        n = rng.randint(2, 25)
        a, b = [rng.randrange(3) for _ in range(n)], [rng.randrange(4) for _ in range(n)]
        table = {}
        for x, y in zip(a, b):
            table[(x, y)] = table.get((x, y), 0) + 1
        same = [(a[i] == a[j], b[i] == b[j]) for i in range(n) for j in range(i)]
        both, one, two, total = sum(p and q for p, q in same), sum(p for p, _ in same), sum(q for _, q in same), len(same)
        expected = one * two / total
        want = 1.0 if (one + two) / 2 == expected else (both - expected) / ((one + two) / 2 - expected)
        assert CL.adjusted_rand(table) == pytest.approx(want)


def test_matching_of_label_columns(spark):
    rows = [(0, 2)] * 5 + [(0, 1)] * 2 + [(1, 2)] * 4 + [(1, 0)] * 3 + [(2, 1)] * 6 + [(None, 1), (2, None)]
    df = spark.createDataFrame(rows, "kmeans_label int, fuzzy_label int")
    m = CL.match_clusterings(df)
    assert m.pairs == {0: 2, 1: 0, 2: 1} and (m.agreeing, m.total) == (14, 20)
    assert {(r.kmeans_label, r.matched_label) for r in CL.with_matched_label(df, m).collect()} == {(0, 2), (1, 0), (2, 1), (None, None)}
    empty = CL.match_clusterings(df.limit(0))
    assert empty.pairs == {} and empty.total == 0
