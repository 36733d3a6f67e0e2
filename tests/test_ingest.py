"""Capture parsing edge cases (FIXTURES.md §1) and file selection."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from postcred.sources.captures import (counted_posts, ingest_counts, read_captures, read_posts, scan_captures,
                                       filter_originals, project_original, dedup_posts)


def _tweet(name, created, rt, text, followers=10, seen="Mon Jan 01 10:00:00 +0000 2018", ext=None):
    rs = {"user": {"screen_name": name, "followers_count": followers}, "created_at": created,
          "retweet_count": rt, "text": text}
    if ext is not None:
        rs["extended_tweet"] = {"full_text": ext}
    return json.dumps({"retweeted_status": rs, "created_at": seen})


LINES = [
    _tweet("  alice ", "Mon Jan 01 09:00:00 +0000 2018", 5, " hi there "),
    _tweet("bob", "Mon Jan 01 09:01:00 +0000 2018", 3, "short", ext="the long text"),
    json.dumps({"created_at": "x", "text": "plain post"}),
    "not json",
    "",
    json.dumps({"retweeted_status": {"created_at": "c", "retweet_count": 1, "text": "no user"}}),
    _tweet("carol", "Mon Jan 01 09:02:00 +0000 2018", "7", "quoted count"),
    _tweet("dave", "Mon Jan 01 09:03:00 +0000 2018", 2, "first", seen="Mon Jan 01 10:00:00 +0000 2018"),
    _tweet("dave", "Mon Jan 01 09:03:00 +0000 2018", 9, "second", seen="Mon Jan 01 11:00:00 +0000 2018"),
    _tweet("erin", "Mon Jan 01 09:04:00 +0000 2018", "5.5", "bad count"),
]


def _lines_df(spark):
    return spark.createDataFrame([(x,) for x in LINES], "value string")


def test_parse_project_dedup(spark):
    posts = {r["screen_name"]: r for r in read_posts(_lines_df(spark)).collect()}
    assert set(posts) == {"alice", "bob", "carol", "dave"}
    assert posts["alice"]["text"] == "hi there"
    assert posts["bob"]["text"] == "the long text"
    assert posts["carol"]["retweet_count"] == 7
    assert posts["dave"]["retweet_count"] == 9 and posts["dave"]["text"] == "second"


def test_dedup_idempotent(spark):
    once = read_posts(_lines_df(spark))
    twice = dedup_posts(once)
    assert sorted(once.collect()) == sorted(twice.collect())


def test_ingest_counts(spark):
    lines = _lines_df(spark)
    posts, of_lines, of_posts = counted_posts(lines)
    assert posts.count() == 4
    r = ingest_counts(of_lines, of_posts, spark, 3, 0.23).first()
    assert r["total_lines"] == len(LINES) and r["original_posts"] == 4
    assert (r["train_rows"], r["test_rows"]) == (3, 1)


def test_folder_selection(spark):
    root = tempfile.mkdtemp(prefix="postcred-cap-")
    for d, name in [("FlumeData", "a.json"), ("other", "FlumeFile.json"), ("other", "skip.json")]:
        os.makedirs(f"{root}/{d}", exist_ok=True)
        with open(f"{root}/{d}/{name}", "w") as fh:
            fh.write(_tweet(d + name, "c", 1, "x") + "\n")
    scanned = {os.path.basename(r["file"]) for r in scan_captures(spark, root).collect()}
    assert scanned == {"a.json", "FlumeFile.json"}
    names = {r["screen_name"] for r in project_original(filter_originals(read_captures(spark, root))).collect()}
    assert names == {"FlumeDataa.json", "otherFlumeFile.json"}


def test_dedup_is_a_total_order(spark):
    """Rows equal in time, retweets and text: the answer does not depend on the input order."""
    from postcred.sources.captures import dedup_posts
    schema = "screen_name string, created_at string, text string, followers_count long, retweet_count long, observed_at timestamp"
    rows = [("a", "t", "same", n, 3, None) for n in (1, 9, 4)]
    for some in (rows, rows[::-1]):
        got = dedup_posts(spark.createDataFrame(some, schema).coalesce(1)).collect()
        assert [(r.followers_count, r.text) for r in got] == [(9, "same")]
