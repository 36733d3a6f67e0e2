"""Explicit schemas. JSON captures are never schema-inferred."""

from __future__ import annotations

from pyspark.sql import types as T

# Capture line: only the fields the engine reads.  Counts are read as strings and cast later so
# that ``5`` and ``"5"`` both work (the reference calls int() on them).
ORIGINAL_STATUS = T.StructType([
    T.StructField("user", T.StructType([
        T.StructField("screen_name", T.StringType()),
        T.StructField("followers_count", T.StringType()),
    ])),
    T.StructField("created_at", T.StringType()),
    T.StructField("retweet_count", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("extended_tweet", T.StructType([T.StructField("full_text", T.StringType())])),
])

CAPTURE_SCHEMA = T.StructType([
    T.StructField("retweeted_status", ORIGINAL_STATUS),
    T.StructField("created_at", T.StringType()),
])

KEY = ("screen_name", "created_at")

FEATURES = ("nfrq", "positive", "negative", "entropy", "topic_weight")

FEATURE_TABLE_SCHEMA = T.StructType([T.StructField(c, T.DoubleType()) for c in FEATURES])
