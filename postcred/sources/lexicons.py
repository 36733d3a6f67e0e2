"""Lexicon tables (inputs of L1-L3) and stop words.

No lexicon library is available, so lexicons are plain tables a user loads from files
(``read_lexicon``).  For tests and the oracle check, ``fixture_*`` derive deterministic lexicons
from the distinct cleaned terms of the posts with fixed formulas that DuckDB can reproduce.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postcred.functions.features import DECEPTION_CATEGORIES
from postcred.operators.blocks import distinct_tokens

SENTIMENT_SCHEMA = "term string, score int, kind string"
SUBJECTIVITY_SCHEMA = "term string, subjectivity double"
CATEGORY_SCHEMA = "category string, term string"

# Fixed fixture formulas (FIXTURES.md §2), shared with the oracle SQL.
FIXTURE_SCORE_SQL = "(length(term) * 7 + ascii(term)) % 11 - 5"
FIXTURE_SUBJECTIVITY_SQL = "((length(term) * 3 + ascii(term)) % 10) / 10.0"
FIXTURE_CATEGORY_INDEX_SQL = "(length(term) + ascii(term)) % 9"


def read_lexicon(spark: SparkSession, path: str, schema: str, fmt: str = "csv", sep: str = "\t") -> DataFrame:
    """Load a lexicon file with an explicit schema (csv/tsv with header, or parquet)."""
    if fmt == "parquet":
        return spark.read.schema(schema).parquet(path)
    return spark.read.schema(schema).option("header", "true").option("sep", sep).csv(path)


def distinct_terms(tokens_df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Distinct non-empty cleaned terms of a token column (one aggregation, over what is distinct within a batch)."""
    return distinct_tokens(tokens_df, F.col(tokens)).where(F.col("_word") != "").select(F.col("_word").alias("term"))


def fixture_sentiment(terms: DataFrame) -> DataFrame:
    """Valence per term from the fixed formula, zeros dropped; all of kind ``word``."""
    return (terms.select("term", F.expr(FIXTURE_SCORE_SQL).cast("int").alias("score"))
            .where(F.col("score") != 0).withColumn("kind", F.lit("word")))


def fixture_subjectivity(terms: DataFrame) -> DataFrame:
    return terms.select("term", F.expr(FIXTURE_SUBJECTIVITY_SQL).cast("double").alias("subjectivity"))


def fixture_categories(terms: DataFrame) -> DataFrame:
    cats = F.array(*[F.lit(c) for c in DECEPTION_CATEGORIES])
    idx = F.expr(FIXTURE_CATEGORY_INDEX_SQL)
    return terms.select(F.get(cats, idx).alias("category"), "term")
