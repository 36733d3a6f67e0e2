"""Saved model bundles: versions, whole or not at all, and equal scores in a new session."""

import os
import subprocess
import sys

import pytest

from postcred.plans import models as M
from postcred.plans import pipeline as P
from postcred.schemas import FEATURES

ROWS = [(f"p{i:03d}", "t", *[float((i % 3) * 4 + (i * (j + 3)) % 5 * 0.1) for j in range(5)]) for i in range(45)]
DDL = "screen_name string, created_at string, " + ", ".join(f"{c} double" for c in FEATURES)


def fitted(spark, **options):
    cfg = P.PipelineConfig(k=3, algorithm="fuzzy c-means", compare_both=True, mlp_max_iter=30, stopwords=("the", "and"), **options)
    weights = spark.createDataFrame([("good", 0.5), ("story", 0.25)], "term string, weight double")
    return M.fit_model(spark, P.land(spark.createDataFrame(ROWS, DDL)), cfg, weights)[0]


def scores(bundle, spark):
    return sorted(tuple(r) for r in M.score_features(bundle, spark.createDataFrame(ROWS, DDL)).collect())


@pytest.mark.parametrize("nmf", [False, True])
def test_round_trip(spark, tmp_path, nmf):
    bundle = fitted(spark, use_nmf=nmf, nmf_max_iter=10)
    lexicon = spark.createDataFrame([("good", 2, "word")], "term string, score int, kind string")
    path = str(tmp_path / "m")
    assert M.save_bundle(bundle, path, lexicon) == 1
    back, lex = M.load_bundle(spark, path)
    assert scores(back, spark) == scores(bundle, spark)
    assert back.cfg == bundle.cfg and back.diagnostics == bundle.diagnostics and [tuple(r) for r in lex.collect()] == [("good", 2, "word")]
    assert sorted(map(tuple, back.weights.collect())) == [("good", 0.5), ("story", 0.25)]


def test_versions_and_half_written_ones(spark, tmp_path):
    path = str(tmp_path / "m")
    with pytest.raises(FileNotFoundError):
        M.load_bundle(spark, path)
    bundle = fitted(spark)
    assert M.save_bundle(bundle, path) == 1 and M.save_bundle(bundle, path) == 2
    bundle.weights.write.parquet(f"{path}/v000003/weights")  # a save that died before its manifest
    assert M.bundle_versions(spark, path) == [1, 2]
    assert scores(M.load_bundle(spark, path, 1)[0], spark) == scores(M.load_bundle(spark, path)[0], spark)
    assert M.load_bundle(spark, path)[1] is None
    with pytest.raises(FileNotFoundError):
        M.load_bundle(spark, path, 3)


def test_a_new_session_scores_alike(spark, tmp_path):
    bundle = fitted(spark)
    path = str(tmp_path / "m")
    M.save_bundle(bundle, path)
    code = f"""
import sys; sys.path[:0] = {[os.path.dirname(os.path.abspath(__file__)), os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]!r}
from test_bundle import M, scores
from postcred.session import build_session
spark = build_session('local[2]', shuffle_partitions=2, extra={{'spark.driver.memory': '2g'}})
print('SCORES', [(r[0], r[-2], r[-1]) for r in scores(M.load_bundle(spark, {path!r})[0], spark)])
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    line = next(x for x in out.stdout.splitlines() if x.startswith("SCORES"))
    assert line == f"SCORES {[(r[0], r[-2], r[-1]) for r in scores(bundle, spark)]}"
