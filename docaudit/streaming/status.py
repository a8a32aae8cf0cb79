"""Documents checked as they arrive, and their latest status."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.operators.report import evaluate, report, status
from docaudit.plans.profiles import PROGRESS, Rule


def check_arrivals(spark: SparkSession, source: str, schema: str, facts: Callable[[DataFrame], DataFrame], rules: list[Rule], sink: str, checkpoint: str):
    """A stream that evaluates new files of documents and appends result rows; it ends when all files are read.

    Facts and rules are those of the batch path. Result rows are per document, so no state is kept.
    """
    arriving = spark.readStream.schema(schema).parquet(source)
    results = evaluate(facts(arriving), rules)
    return results.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def arrival_reports(results: DataFrame) -> DataFrame:
    """Reports and statuses of result rows that a stream has written."""
    return status(report(results))


def latest_status(events: DataFrame, key: str, time: str, tie: str, value: str) -> DataFrame:
    """Latest value of each key by time, then by a tie-breaking id. On a stream use outputMode complete or update."""
    return events.groupBy(key).agg(F.max_by(value, F.struct(time, tie)).alias("status"))


def with_progress(rows: DataFrame, column: str = "status", table: dict[str, int] = PROGRESS) -> DataFrame:
    """Progress of a status (0 if unknown), and the seconds that are left."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    progress = F.coalesce(F.create_map(*pairs)[F.col(column)], F.lit(0))
    return rows.withColumn("progress", progress).withColumn("seconds_left", F.when(progress == 100, 0).otherwise(30))
