"""Incremental landing equals a full rebuild and leaves untouched buckets alone; counts come from the same scan."""

import glob
import json
import os

import pytest

from postcred.plans import pipeline as P
from postcred.sources import captures as CA
from postcred.sources.store import PostStore

POST = "screen_name string, created_at string, followers_count long, retweet_count long, text string, observed_at timestamp"


def posts(spark, rows):
    return spark.createDataFrame(rows, "screen_name string, created_at string, followers_count long, retweet_count long, text string, seen string") \
        .selectExpr("screen_name", "created_at", "followers_count", "retweet_count", "text", "to_timestamp(seen) observed_at")


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def files(path):
    return {f: (os.path.getmtime(f), os.path.getsize(f)) for f in glob.glob(f"{path}/data/**/*.parquet", recursive=True)}


def test_merge_equals_a_rebuild(spark, tmp_path):
    first = [(f"u{i}", "t", i, i, f"text {i}", "2018-01-01 10:00:00") for i in range(60)]
    later = [("u3", "t", 9, 99, "newer", "2018-01-02 10:00:00"), ("u4", "t", 9, 99, "older", "2017-01-02 10:00:00"), ("new", "t", 1, 1, "x", None),
             ("u3", "t", 9, 98, "same time, fewer", "2018-01-02 10:00:00")]
    store = PostStore(spark, str(tmp_path / "s"))
    made = store.create(posts(spark, first), input_bytes=10_000, bucket_bytes=700)
    assert made["buckets"] == 15 and rows_of(store.read()) == rows_of(posts(spark, first))
    before = files(store.path)
    merged = store.merge(posts(spark, later))
    assert rows_of(store.read()) == rows_of(CA.dedup_posts(posts(spark, first + later)))
    after = files(store.path)
    assert before.items() <= after.items()  # no file was changed
    touched = {b for b, v in merged["versions"].items() if v == 2}
    assert 1 <= len(touched) <= 3 and all("version=2" in f for f in after.keys() - before.keys())
    assert {f.split("bucket=")[1].split("/")[0] for f in after.keys() - before.keys()} == touched
    assert rows_of(store.read(1)) == rows_of(posts(spark, first))  # an earlier state can still be read


def test_half_a_merge_changes_nothing(spark, tmp_path):
    first = [(f"u{i}", "t", i, i, "x", None) for i in range(5)]
    store = PostStore(spark, str(tmp_path / "s"))
    store.create(posts(spark, first), 1000, 300)
    posts(spark, [("u1", "t", 7, 7, "y", None)]).write.parquet(f"{store.path}/data/version=2/bucket=0")  # a merge that died before its manifest
    assert rows_of(store.read()) == rows_of(posts(spark, first))
    store.merge(posts(spark, [("z", "t", 1, 1, "z", None)]))
    assert len(rows_of(store.read())) == 6
    with pytest.raises(FileExistsError):
        store.create(posts(spark, first), 1)
    with pytest.raises(FileNotFoundError):
        PostStore(spark, str(tmp_path / "none")).read()


def test_empty_folders(spark, tmp_path):
    store = PostStore(spark, str(tmp_path / "s"))
    store.create(posts(spark, []), 0)
    assert rows_of(store.read()) == []
    store.merge(posts(spark, []))
    store.merge(posts(spark, [("a", None, 1, 1, "x", None), (None, None, 1, 2, "y", None)]))
    assert len(rows_of(store.read().select("retweet_count"))) == 2


def _line(name="ann", rt=1, followers=3, text="some words", created="c", **more):
    return json.dumps({"retweeted_status": {"user": {"screen_name": name, "followers_count": followers}, "created_at": created, "retweet_count": rt, "text": text},
                       "created_at": "Mon Jan 01 10:00:00 +0000 2018", **more})


def test_counts_by_reason_in_one_scan(spark):
    lines = [_line(), _line(rt="5"), _line("bo"), "", "  \t", "not json", '{"a":', json.dumps({"text": "plain"}), _line(text=None), _line(name=None),
             _line(rt="many"), _line(followers="1.5x"), _line(rt=None), json.dumps({"retweeted_status": {"created_at": "c"}}), _line("cy", extended_tweet={"full_text": "no"})]
    df = spark.createDataFrame([(v,) for v in lines], "value string")
    found, of_lines, of_posts = CA.counted_posts(df)
    plan = found._jdf.queryExecution().executedPlan().toString()
    landed = P.land(found)
    r = CA.ingest_counts(of_lines, of_posts, spark, k=3, test_share=0.25).first().asDict()
    assert r == {"total_lines": 15, "blank_lines": 2, "broken_lines": 2, "without_original": 1, "missing_fields": 4, "bad_counts": 2, "observations": 4,
                 "repeated_observations": 1, "original_posts": 3, "train_rows": 2, "test_rows": 1, "k": 3}
    assert plan.count("Scan ") == 1 and plan.count("Exchange hashpartitioning") == 1
    assert sorted(x["screen_name"] for x in landed.collect()) == ["ann", "bo", "cy"]
    plain = CA.read_posts(df)
    assert rows_of(plain) == rows_of(landed)


def test_counts_of_nothing(spark):
    found, a, b = CA.counted_posts(spark.createDataFrame([], "value string"))
    P.land(found)
    r = CA.ingest_counts(a, b, spark, 3, 0.25).first()
    assert r.total_lines == 0 and r.original_posts == 0 and r.test_rows == 0


def test_landed_entries_can_be_released(spark):
    P.release_landed(spark)
    P.land_posts(spark.createDataFrame([("a", "b", 1)], "screen_name string, created_at string, v int"), buckets=2)
    assert P.release_landed(spark) == 1 and P.release_landed(spark) == 0


def test_report_round_trip(spark, tmp_path):
    """Quotes, backslashes, tabs and empty texts survive the tab-separated report."""
    from postcred.sources.tables import read_report, write_report
    texts = ['say "hi"', "back\\slash", 'end\\', '\\"both\\"', "tab\there", '"', "é 😀", "line one\nline two", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    path = write_report(df, str(tmp_path / "r"))
    assert {r.i: r.text for r in read_report(spark, path, df.schema).collect()} == dict(enumerate(texts))
