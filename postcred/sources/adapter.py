"""Test-data adapter: the driver's ``documents`` / ``conversations`` tables as capture lines.

The test data holds no captured posts, so each document becomes an original post that was
captured twice (two retweets seen at different times, the second with 10 more retweets) and
each conversation turn becomes a plain post without ``retweeted_status``.  The lines then go
through the real JSON parse path (S2-S5).  Column formulas are fixed so that the DuckDB oracle
can rebuild the same posts (see ``postcred.plans.oracle``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postcred.session import scratch_dir

# Fixed adapter formulas (FIXTURES.md §3), shared with the oracle SQL.
CREATED_AT_SQL = (
    "date_format(timestampadd(MINUTE, cast(doc_id as int), timestamp'2018-01-01 00:00:00'),"
    " 'yyyy-MM-dd HH:mm:ss')"
)
FOLLOWERS_SQL = "(doc_id * 37) % 1000"
RETWEETS_SQL = "n_chars % 1500"
RECAPTURE_EXTRA_RETWEETS = 10
TWITTER_OUT_FORMAT = "EEE MMM dd HH:mm:ss Z yyyy"


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _envelope(docs: DataFrame, extra_retweets: int, seen_after_hours: int) -> DataFrame:
    return docs.select(_line(extra_retweets, seen_after_hours).alias("value"))


def _line(extra_retweets: int, seen_after_hours: int) -> Column:
    created = F.expr(CREATED_AT_SQL)
    seen = F.expr(f"timestampadd(HOUR, {seen_after_hours}, "
                  "timestampadd(MINUTE, cast(doc_id as int), timestamp'2018-01-01 00:00:00'))")
    status = F.struct(
        F.struct(F.col("source").alias("screen_name"),
                 F.expr(FOLLOWERS_SQL).alias("followers_count")).alias("user"),
        created.alias("created_at"),
        (F.expr(RETWEETS_SQL) + F.lit(extra_retweets)).alias("retweet_count"),
        F.col("text").alias("text"),
    )
    wrapper = F.struct(status.alias("retweeted_status"),
                       F.date_format(seen, TWITTER_OUT_FORMAT).alias("created_at"))
    return F.to_json(wrapper)


def capture_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture lines (``value``) derived from ``documents`` and ``conversations``.

    Both captures of a document come from one scan, so repeated posts meet in the dedup's map side and the texts move once.
    """
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", "text")
    both = docs.select(F.explode(F.array(_line(0, 1), _line(RECAPTURE_EXTRA_RETWEETS, 2))).alias("value"))
    conv = load_table(spark, sf_dir, "conversations").select(
        F.to_json(F.struct(F.col("text"), F.col("role").alias("lang"))).alias("value"))
    return both.unionByName(conv)


def conversation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture lines of other posts than ``capture_lines`` has: every conversation turn as an original post seen once."""
    conv = load_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    status = F.struct(
        F.struct(F.col("role").alias("screen_name"), F.expr("conv_id % 1000").alias("followers_count")).alias("user"),
        F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("created_at"),
        F.expr("length(text) % 1500").alias("retweet_count"), F.col("text").alias("text"))
    return conv.select(F.to_json(F.struct(status.alias("retweeted_status"))).alias("value"))


def write_capture_folder(spark: SparkSession, sf_dir: str) -> str:
    """Land the adapter's lines as text files: two capture folders plus one the scan must skip."""
    root = scratch_dir(spark, "captures")
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", "text")
    _envelope(docs, 0, 1).write.mode("overwrite").text(f"{root}/FlumeData-1")
    _envelope(docs, RECAPTURE_EXTRA_RETWEETS, 2).write.mode("overwrite").text(f"{root}/FlumeData-2")
    conv = load_table(spark, sf_dir, "conversations").select(F.to_json(F.struct("text")).alias("value"))
    conv.write.mode("overwrite").text(f"{root}/other")
    return root


def adapted_posts_sql_columns() -> dict[str, str]:
    """The post columns as Spark SQL over ``documents`` (for tests that bypass JSON)."""
    return {
        "screen_name": "source",
        "created_at": CREATED_AT_SQL,
        "followers_count": FOLLOWERS_SQL,
        "retweet_count": f"{RETWEETS_SQL} + {RECAPTURE_EXTRA_RETWEETS}",
        "text": "text",
    }
