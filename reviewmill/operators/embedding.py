"""Text to vectors: a hook for an outside model, and a built-in offline model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F, types as T

from reviewmill import constants as C
from reviewmill.functions import text as X


def embed_reviews(
    reviews: DataFrame,
    embed_fn: Callable[[list[str]], tuple[np.ndarray, int]],
    batch_size: int = C.EMBED_BATCH,
) -> DataFrame:
    """The reviews with embedding, call_tokens and opens_call added, still in the same rows.

    embed_fn(texts) returns (matrix, tokens used) and is called in the tasks with at most
    batch_size texts at a time; blank text is sent as one space. The first row of each call is
    marked and carries its tokens, so plain sums over rows are right. A lost task calls again for
    its part: store the result once and read it from there.
    """
    source = reviews.withColumn("_sent", X.embeddable(F.col("text")))
    kept = reviews.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, batch_size):
                part = batch.slice(start, batch_size)
                matrix, tokens = embed_fn(part.column("_sent").to_pylist())
                matrix = np.asarray(matrix, dtype=np.float32)
                n, width = matrix.shape
                if n != part.num_rows:
                    raise ValueError(f"asked for {part.num_rows} vectors, got {n}")
                offsets = np.arange(0, (n + 1) * width, width, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in kept]
                    + [
                        pa.ListArray.from_arrays(offsets, pa.array(matrix.ravel())),
                        pa.array([int(tokens)] + [0] * (n - 1), pa.int64()),
                        pa.array([True] + [False] * (n - 1)),
                    ],
                    names=[*kept, "embedding", "call_tokens", "opens_call"],
                )

    schema = T.StructType(list(reviews.schema.fields))
    schema.add("embedding", T.ArrayType(T.FloatType()))
    schema.add("call_tokens", T.LongType()).add("opens_call", T.BooleanType())
    return source.mapInArrow(run, schema)


def embedding_usage(embedded: DataFrame, step: str, model: str) -> DataFrame:
    """Ledger rows (step, model, tokens_in, tokens_out), one per call of embed_fn; call is the id of its first review."""
    return embedded.where("opens_call").select(
        F.lit(step).alias("step"), F.lit(model).alias("model"),
        F.col("call_tokens").alias("tokens_in"), F.lit(0).cast("bigint").alias("tokens_out"),
        F.col("review_id").cast("string").alias("call"),
    )


def fit_offline_embedder(reviews: DataFrame, width: int = 256):
    """Hashed TF-IDF with unit length, all inside the JVM: works without any outside model."""
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[^\p{L}\p{N}]+"),
            HashingTF(inputCol="words", outputCol="tf", numFeatures=width),
            IDF(inputCol="tf", outputCol="tfidf"),
            Normalizer(inputCol="tfidf", outputCol="dense"),
        ]
    ).fit(reviews.select(X.embeddable(F.col("text")).alias("text")))


def embed_offline(model, reviews: DataFrame) -> DataFrame:
    """The reviews with embedding added."""
    kept = reviews.withColumnRenamed("text", "_text").withColumn(
        "text", X.embeddable(F.col("_text"))
    )
    return (
        model.transform(kept)
        .withColumn("embedding", vector_to_array("dense", "float32"))
        .drop("text", "words", "tf", "tfidf", "dense")
        .withColumnRenamed("_text", "text")
    )
