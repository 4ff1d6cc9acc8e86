"""Cost ledger: price per call, totals, and sums by step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from reviewmill.constants import MODEL_PRICES


def price_table(spark: SparkSession, prices: dict = MODEL_PRICES) -> DataFrame:
    return spark.createDataFrame(
        [(model, float(i), float(o)) for model, (i, o) in prices.items()],
        "model string, price_in double, price_out double",
    )


def call_cost(calls: DataFrame, prices: dict = MODEL_PRICES) -> DataFrame:
    """Adds cost in USD; a model without a price costs nothing."""
    rates = F.broadcast(price_table(calls.sparkSession, prices))  # a handful of rows
    cost = (
        F.col("tokens_in") * F.col("price_in") + F.col("tokens_out") * F.col("price_out")
    ) / F.lit(1_000_000)
    return (
        calls.join(rates, "model", "left")
        .withColumn("cost", F.coalesce(cost, F.lit(0.0)))
        .select(*calls.columns, "cost")
    )


def total_cost(costs: DataFrame) -> DataFrame:
    return costs.agg(F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("total_cost_usd"))


def cost_by_step(costs: DataFrame) -> DataFrame:
    """step, calls, tokens_in, tokens_out, cost, model (of the first call by seq).

    Grouping by step and model first keeps every buffer numeric; the second level is tiny.
    """
    per_model = costs.groupBy("step", "model").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"),
        F.sum("cost").alias("cost"),
        F.min("seq").alias("first_seq"),
    )
    return per_model.groupBy("step").agg(
        F.sum("calls").alias("calls"),
        F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"),
        F.sum("cost").alias("cost"),
        F.min_by("model", "first_seq").alias("model"),
    )
