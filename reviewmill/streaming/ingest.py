"""Incremental intake: new review files are cleaned, and flagged against a frozen threshold.

Cleaning and flagging look at one row at a time once the threshold is fixed, so the batch operators
run unchanged on a stream of arriving files; no state and no watermark are needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery

from reviewmill.operators.cleaning import clean
from reviewmill.operators.spam import flag, score_rows
from reviewmill.schema import EMBEDDING, REVIEW


def stream_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Cleaned reviews from Parquet files as they arrive in a folder."""
    return clean(spark.readStream.schema(REVIEW).parquet(folder))


def stream_scored(spark: SparkSession, folder: str, prototypes) -> DataFrame:
    """Cleaned and scored reviews from files that also hold the embedding."""
    schema = T.StructType([*REVIEW.fields, EMBEDDING["embedding"]])
    return score_rows(clean(spark.readStream.schema(schema).parquet(folder)), prototypes)


def append_flags(
    scored: DataFrame, threshold: float, path: str, checkpoint: str
) -> StreamingQuery:
    """Append flags of everything that has arrived, exactly once, then stop."""
    return (
        flag(scored, threshold)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
