"""Invariants of the iterative fits: c-means, NMF, k-means, the network and warm starts."""

import pytest
from pyspark.sql import functions as F

from postcred.operators import cluster as CL
from postcred.operators.classify import mlp_fit, mlp_fit_incremental, mlp_predict
from postcred.operators.factorize import nmf_apply, nmf_fit
from postcred.operators.evaluate import accuracy, classification_report, confusion_matrix


def _blobs(spark, n=60):
    rows = []
    for i in range(n):
        c = i % 3
        rows.append((f"p{i:03d}", "t", float(c * 5 + (i % 7) * 0.1), float(c * 3 + (i % 5) * 0.1)))
    return spark.createDataFrame(rows, "screen_name string, created_at string, a double, b double")


def test_fuzzy_cmeans_recovers_blobs(spark):
    df = _blobs(spark).cache()
    res = CL.fuzzy_cmeans_fit(df, 3, cols=["a", "b"], max_iter=100, seed=3)
    assert res.error < 0.005
    xs = sorted(round(c[0]) for c in res.centers)
    assert xs == [0, 5, 10]
    m = CL.membership_max(CL.fuzzy_memberships(df, res.centers, cols=["a", "b"]))
    assert m.select(F.countDistinct("fuzzy_label")).first()[0] == 3
    assert 0.0 < res.fpc <= 1.0


def test_kmeans_canonical(spark):
    df = _blobs(spark)
    _, centers = CL.kmeans_fit(df, 3, cols=["a", "b"], seed=5)
    assert centers == sorted(centers)
    lab = CL.kmeans_assign(df, centers, cols=["a", "b"])
    by = {r["screen_name"]: r["kmeans_label"] for r in lab.collect()}
    assert by["p000"] == 0 and by["p002"] == 2


def test_nmf_nonnegative_and_improves(spark):
    df = _blobs(spark).select("a", "b", (F.col("a") + F.col("b")).alias("c"))
    model = nmf_fit(df, cols=["a", "b", "c"], rank=2, max_iter=40, tol=0.0)
    assert all(v >= 0 for row in model.basis for v in row)
    assert model.errors[-1] < model.errors[0]
    h = nmf_apply(df, model, ["h0", "h1"]).collect()
    assert all(r["h0"] >= 0 and r["h1"] >= 0 for r in h)


def test_mlp_and_warm_start(spark):
    df = _blobs(spark).withColumn("label", (F.col("a") / 5).cast("int"))
    model = mlp_fit(df, 3, cols=["a", "b"], max_iter=200, seed=21)
    pred = mlp_predict(model, df, cols=["a", "b"])
    assert accuracy(pred).first()["accuracy_pct"] > 90
    inc = mlp_fit_incremental([df.where(F.col("a") < 5.5), df], 3, cols=["a", "b"], max_iter_per_batch=30)
    assert len(inc.flat()) == len(model.flat()) and inc.steps == 60


def test_confusion_and_report(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (2, 1)], "label int, predicted int")
    cm = {(r["actual"], r["predicted"]): r["n"] for r in confusion_matrix(df).collect()}
    assert len(cm) == 9 and cm[(1, 1)] == 2 and cm[(2, 2)] == 0
    rep = {r["class"]: r for r in classification_report(df).collect()}
    assert rep["1"]["precision"] == pytest.approx(0.5) and rep["1"]["recall"] == pytest.approx(1.0)
    assert rep["2"]["precision"] == 0.0 and rep["2"]["f1"] == 0.0
    assert rep["accuracy"]["f1"] == pytest.approx(0.6)


def test_reports_do_not_carry_the_network(spark):
    """The report reads counted labels: the network's layers, which grow in filters pushed into them, are not in its plan."""
    from postcred.operators.classify import new_network
    df = _blobs(spark).withColumn("label", F.when(F.col("a") > 4, 1).otherwise(0))
    pred = mlp_predict(new_network(2, 2), df, cols=["a", "b"])
    plan = classification_report(pred)._jdf.queryExecution().analyzed().toString()
    assert "_layer" not in plan
    want = {}
    for r in pred.collect():
        want[r["label"], r["predicted"]] = want.get((r["label"], r["predicted"]), 0) + 1
    got = {(r["actual"], r["predicted"]): r["n"] for r in confusion_matrix(pred).collect()}
    assert {k: n for k, n in got.items() if n} == want
    odd = spark.createDataFrame([(None, 1), (1, 1), (1, None), (0, 1)], "label int, predicted int")
    got = {(r["actual"], r["predicted"]): r["n"] for r in confusion_matrix(odd).collect()}
    assert len(got) == 9 and {k: n for k, n in got.items() if n} == {(1, 1): 1, (0, 1): 1}


def test_nmf_step_works_in_batches_and_equals_the_row_expression(spark, monkeypatch):
    """The fit computes coordinates over batches (not by a lambda per row), also of many ranges; rows with a null add nothing."""
    import numpy as np
    from postcred.operators import factorize as FZ
    rows = [(float(i % 7), float(i * i % 11), 0.5 * (i % 3)) for i in range(50)] + [(None, 1.0, 2.0), (0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(3)
    W, cols = np.array([[0.5, 1.0, 0.2], [1.5, 0.1, 0.7]]), ["a", "b", "c"]
    h = [(np.array([r["a"], r["b"], r["c"]]), np.array(r["_h"])) for r in FZ.with_coords(df.na.drop(), cols, W, 0.6, 9).collect()]
    hx, hh = sum(np.outer(c, x) for x, c in h), sum(np.outer(c, c) for _, c in h)
    monkeypatch.setattr(FZ, "with_coords", None)
    monkeypatch.setattr(FZ, "WORK_ROWS", 4)
    new, err = FZ.nmf_step(df, cols, W, 0.6, 9)
    assert new == pytest.approx(W * hx / (hh @ W), rel=1e-9)
    assert err == pytest.approx(sum(((x - c @ W) ** 2).sum() for x, c in h) ** 0.5, rel=1e-9)
    assert FZ.nmf_step(df.limit(0), cols, W, 0.6, 9)[1] == 0.0
