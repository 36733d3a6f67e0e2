"""Capture ingest (S1-S7): folders of line-delimited post JSON -> one row per original post.

Plan shape: text scan (splittable) -> ``from_json`` with an explicit schema -> filter -> project
-> one shuffle on the post key for the dedup.  Everything downstream is keyed by the same two
columns, so later per-post aggregates reuse this partitioning instead of shuffling again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postcred.functions.text import strip_ws
from postcred.schemas import CAPTURE_SCHEMA, KEY

# Fixed value: the reference keeps a capture file when its full path contains this text.
CAPTURE_PATH_MARK = "Flum"

# Twitter's created_at text is "Mon Jan 01 10:00:00 +0000 2018"; the weekday is skipped because
# Spark 3+ rejects "EEE" when parsing.
TWITTER_TS_FORMAT = "MMM dd HH:mm:ss Z yyyy"


def scan_captures(spark: SparkSession, folder: str, path_contains: str = CAPTURE_PATH_MARK) -> DataFrame:
    """Every line of every file below ``folder`` whose full path contains ``path_contains``.

    Returns ``(value, file)``.  A matching *directory* name counts too, hence the filter on the
    full path from the hidden ``_metadata`` column rather than ``pathGlobFilter`` (file name only).
    """
    df = spark.read.option("recursiveFileLookup", "true").text(folder)
    return (
        df.select("value", F.col("_metadata.file_path").alias("file"))
        .where(F.col("file").contains(path_contains))
    )


def parse_posts(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """Parse each line with the explicit capture schema; bad lines give a NULL struct.

    The parsed struct is produced by a one-element ``explode`` so that it is computed exactly
    once per line: filters on its fields stay above the generator instead of being pushed
    below it, where Catalyst would inline one JSON parse into every predicate.
    """
    parsed = F.from_json(F.col(value_col), CAPTURE_SCHEMA, {"mode": "PERMISSIVE"})
    keep = [c for c in lines.columns if c != value_col]
    return lines.select(*keep, F.explode(F.array(parsed)).alias("tweet"))


def read_captures(spark: SparkSession, folder: str, path_contains: str = CAPTURE_PATH_MARK) -> DataFrame:
    """S1 + S2 in one scan: the JSON source parses each line once with the explicit schema.

    Same file selection as ``scan_captures``; lines that fail to parse give NULL fields and are
    removed by ``filter_originals``, which the JSON source can evaluate while parsing.
    """
    df = (spark.read.schema(CAPTURE_SCHEMA).option("mode", "PERMISSIVE")
          .option("recursiveFileLookup", "true").json(folder))
    return (
        df.select(F.struct(*[F.col(c) for c in CAPTURE_SCHEMA.fieldNames()]).alias("tweet"),
                  F.col("_metadata.file_path").alias("file"))
        .where(F.col("file").contains(path_contains))
    )


def filter_originals(parsed: DataFrame) -> DataFrame:
    """S3: keep lines that carry an original post (``retweeted_status``)."""
    return parsed.where(F.col("tweet.retweeted_status").isNotNull())


def _observed_ts(c: Column) -> Column:
    """Timestamp of the wrapping capture: Twitter format or ISO text; NULL if neither."""
    return F.coalesce(
        F.try_to_timestamp(F.substring(c, 5, 26), F.lit(TWITTER_TS_FORMAT)),
        F.try_to_timestamp(c),
    )


def project_original(parsed: DataFrame) -> DataFrame:
    """Author, created_at, follower / retweet counts and text of the original post.

    Text is ``extended_tweet.full_text`` when present, else ``text``; strings are trimmed.  Rows
    whose fields are missing or whose counts are not integers are dropped (the reference skips
    or aborts, see quirk Q13).
    """
    rs = F.col("tweet.retweeted_status")
    full = rs["extended_tweet"]["full_text"]
    text = F.when(full.isNotNull(), full).otherwise(rs["text"])
    followers = F.expr("try_cast(tweet.retweeted_status.user.followers_count as bigint)")
    retweets = F.expr("try_cast(tweet.retweeted_status.retweet_count as bigint)")
    # validity is tested on the raw fields (cheap) so the trims below run once per row
    valid = parsed.where(
        rs["user"]["screen_name"].isNotNull() & rs["created_at"].isNotNull()
        & followers.isNotNull() & retweets.isNotNull() & text.isNotNull()
    )
    return valid.select(
        strip_ws(rs["user"]["screen_name"]).alias("screen_name"),
        strip_ws(rs["created_at"]).alias("created_at"),
        followers.alias("followers_count"),
        retweets.alias("retweet_count"),
        strip_ws(text).alias("text"),
        _observed_ts(F.col("tweet.created_at")).alias("observed_at"),
    )


#: Columns that say which observation of a post is the latest.
ORDER = ("observed_at", "retweet_count", "text")


def dedup_posts(posts: DataFrame, key=KEY) -> DataFrame:
    """One row per post key; the latest observation wins.

    Ties are broken by retweet count, text and then every other column, so the result does not
    depend on file order (quirk Q3).  ``max`` of one struct is a partial aggregate that carries each
    column once: a key observed millions of times collapses map-side before the shuffle.
    """
    others = [c for c in posts.columns if c not in key]
    order = [c for c in ORDER if c in others]
    agg = posts.groupBy(*key).agg(F.max(F.struct(*order, *[c for c in others if c not in order])).alias("_last"))
    return agg.select(*key, *[F.col("_last")[c].alias(c) for c in others])


def union_captures(*frames: DataFrame) -> DataFrame:
    """Merge results of several capture sets (dedup afterwards with ``dedup_posts``)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def read_posts(lines: DataFrame) -> DataFrame:
    """S2 -> S3 -> S4 -> S5: capture lines to one row per original post."""
    return dedup_posts(project_original(filter_originals(parse_posts(lines))))


#: Reasons for which a capture line gives no post, in the order they are tested; one line counts under one reason.
DROP_REASONS = ("blank_lines", "broken_lines", "without_original", "missing_fields", "bad_counts")


def drop_reason(value_col: str = "value") -> Column:
    """Why a line gives no post (one of ``DROP_REASONS``), or null if it gives one.  ``tweet`` is the parsed line."""
    rs = F.col("tweet.retweeted_status")
    text = F.coalesce(rs["extended_tweet"]["full_text"], rs["text"])
    missing = (rs["user"]["screen_name"].isNull() | rs["created_at"].isNull() | text.isNull()
               | rs["user"]["followers_count"].isNull() | rs["retweet_count"].isNull())
    bad = (F.expr("try_cast(tweet.retweeted_status.user.followers_count as bigint)").isNull()
           | F.expr("try_cast(tweet.retweeted_status.retweet_count as bigint)").isNull())
    whole = F.col("tweet._broken").isNull()
    return (F.when(strip_ws(F.col(value_col)) == "", F.lit(DROP_REASONS[0])).when(~whole, F.lit(DROP_REASONS[1]))
            .when(rs.isNull(), F.lit(DROP_REASONS[2])).when(missing, F.lit(DROP_REASONS[3])).when(bad, F.lit(DROP_REASONS[4])))


def counted_posts(lines: DataFrame, value_col: str = "value") -> tuple[DataFrame, Observation, Observation]:
    """S2-S5 with counts taken on the way: (deduplicated posts, counts of lines, counts of posts).

    The observations are filled by the first action on the posts (their landing), so counting adds no scan and no shuffle.
    """
    schema = T.StructType([*CAPTURE_SCHEMA.fields, T.StructField("_broken", T.StringType())])
    parsed = F.from_json(F.col(value_col), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    rows = lines.select(F.col(value_col).alias("value"), F.explode(F.array(parsed)).alias("tweet"))
    rows = rows.select("tweet", F.coalesce(drop_reason(), F.lit("")).alias("_reason"))
    of_lines, of_posts = Observation(), Observation()
    rows = rows.observe(of_lines, F.count(F.lit(1)).alias("total_lines"),
                        *[F.count(F.when(F.col("_reason") == r, 1)).alias(r) for r in DROP_REASONS],
                        F.count(F.when(F.col("_reason") == "", 1)).alias("observations"))
    posts = dedup_posts(project_original(rows.where(F.col("_reason") == "")))
    return posts.observe(of_posts, F.count(F.lit(1)).alias("original_posts")), of_lines, of_posts


def ingest_counts(of_lines: Observation, of_posts: Observation, spark: SparkSession, k: int, test_share: float) -> DataFrame:
    """One row with the lines, the dropped ones by reason, the posts, the repeated observations, the split and ``k``.

    Call it after an action on ``counted_posts``'s posts.
    """
    lines, n = dict(of_lines.get), int(of_posts.get["original_posts"])
    test = math.ceil(test_share * n)
    row = {**{c: int(lines[c]) for c in ("total_lines", *DROP_REASONS, "observations")}, "repeated_observations": int(lines["observations"]) - n,
           "original_posts": n, "train_rows": n - test, "test_rows": test, "k": k}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} long" for c in row))
