"""Writing the report, the tickets and the cost ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from reviewmill.operators.export import ticket_fields, ticket_payload
from reviewmill.operators.scale import path_exists, pin


def write_report(sections: DataFrame, path: str) -> None:
    """One UTF-8 Markdown file. There is one section per cluster and three more."""
    (
        sections.coalesce(1)
        .sortWithinPartitions("section_no")
        .select("markdown")
        .write.mode("overwrite")
        .text(path)
    )


def write_tickets(tickets: DataFrame, path: str) -> None:
    """One JSON object {"fields": ...} per line."""
    ticket_fields(tickets).select("fields").write.mode("overwrite").json(path)


def write_ticket_payload(tickets: DataFrame, path: str) -> None:
    """The bulk-create requests, a JSON document a line, in order; each holds a bounded number of tickets."""
    parts = ticket_payload(tickets)
    parts.repartitionByRange("part").sortWithinPartitions("part").select("payload").write.mode("overwrite").text(path)


def append_calls(calls: DataFrame, path: str, run_id: str) -> None:
    """Add a run's model calls (step, model, tokens_in, tokens_out, cost) to the ledger.

    The ledger only grows: an earlier run's costs stay when a later one reuses its stages. seq goes on from the run's largest
    one, so it is unique in a run. Calls with a column call, their name within the step, are paid once in a run: a stage that
    is repeated after a failure adds only those that the ledger does not have yet.
    """
    known = read_calls(calls.sparkSession, path).where(F.col("run_id") == run_id)
    if "call" in calls.columns:
        paid = known.where("call IS NOT NULL").select("step", "call").distinct()
        calls = calls.dropDuplicates(["step", "call"]).join(pin(paid), ["step", "call"], "left_anti")
    last = known.agg(F.max("seq")).first()[0]
    pin(calls.select(
        F.lit(run_id).alias("run_id"),
        (F.monotonically_increasing_id() + (0 if last is None else last + 1)).alias("seq"),
        "step", "model", "tokens_in", "tokens_out", "cost",
        F.current_timestamp().alias("timestamp"),
        (F.col("call").cast("string") if "call" in calls.columns else F.lit(None).cast("string")).alias("call"),
    )).write.mode("append").parquet(path)


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """The ledger; empty before the first call was paid for."""
    schema = (
        "run_id string, seq bigint, step string, model string, tokens_in bigint, "
        "tokens_out bigint, cost double, timestamp timestamp, call string"
    )
    if path_exists(spark, path):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)
