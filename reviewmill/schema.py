"""Column contracts of the tables that travel between stages, and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from reviewmill.constants import REQUIRED_COLUMNS

REVIEW = T.StructType([
    T.StructField("review_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("recommended", T.BooleanType()),
    T.StructField("playtime_hours", T.DoubleType()),
    T.StructField("posted_at", T.StringType()),
])

EMBEDDING = T.StructType([
    T.StructField("review_id", T.LongType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

QUOTE = T.StructType([
    T.StructField("review_id", T.LongType()),
    T.StructField("text", T.StringType()),
])

TOPIC = T.StructType([
    T.StructField("cluster_id", T.IntegerType()),
    T.StructField("size", T.LongType()),
    T.StructField("topic", T.StringType()),
    T.StructField("topic_en", T.StringType()),
    T.StructField("summary", T.ArrayType(T.StringType())),
    T.StructField("summary_en", T.ArrayType(T.StringType())),
    T.StructField("sentiment", T.StringType()),
    T.StructField("keywords_ko", T.ArrayType(T.StringType())),
    T.StructField("keywords_en", T.ArrayType(T.StringType())),
    T.StructField("representative_quotes", T.ArrayType(QUOTE)),
])

ISSUE = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("title_en", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("description_en", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("frequency", T.IntegerType()),
    T.StructField("representative_quotes", T.ArrayType(QUOTE)),
])

NEGATIVE = T.StructType([
    T.StructField("cluster_id", T.IntegerType()),
    T.StructField("topic", T.StringType()),
    T.StructField("topic_en", T.StringType()),
    T.StructField("negative_review_count", T.LongType()),
    T.StructField("issues", T.ArrayType(ISSUE)),
])

CALL = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("step", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("tokens_in", T.LongType()),
    T.StructField("tokens_out", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
])

# Replies are read with every scalar as text, so that one odd value does not void a record.
TOPIC_REPLY = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("topic_en", T.StringType()),
    T.StructField("summary", T.ArrayType(T.StringType())),
    T.StructField("summary_en", T.ArrayType(T.StringType())),
    T.StructField("sentiment", T.StringType()),
    T.StructField("keywords_ko", T.ArrayType(T.StringType())),
    T.StructField("keywords_en", T.ArrayType(T.StringType())),
    T.StructField("representative_quote_ids", T.ArrayType(T.StringType())),
])

ISSUE_REPLY = T.StructType([
    T.StructField("issues", T.ArrayType(T.StructType([
        T.StructField("title", T.StringType()),
        T.StructField("title_en", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("description_en", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("frequency", T.StringType()),
        T.StructField("representative_quote_ids", T.ArrayType(T.StringType())),
    ]))),
])


class MissingColumns(ValueError):
    """The input lacks columns of the review contract."""


class DuplicateReviews(ValueError):
    """review_id is not a key of the input."""


def select_required(df: DataFrame) -> DataFrame:
    """Keep exactly the review columns, cast to their types; complain about absent ones."""
    missing = [c for c in REQUIRED_COLUMNS if c not in df.columns]
    if missing:
        raise MissingColumns("missing required columns: " + ", ".join(sorted(missing)))
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in REVIEW])


def require_unique_ids(df: DataFrame) -> DataFrame:
    """Fail fast when a review_id is missing or occurs twice; returns the frame unchanged."""
    if not df.where("review_id IS NULL").isEmpty():
        raise DuplicateReviews("a row has no review_id")
    repeated = df.groupBy("review_id").count().where("count > 1").limit(1).collect()
    if repeated:
        raise DuplicateReviews(f"review_id {repeated[0]['review_id']} occurs more than once")
    return df
