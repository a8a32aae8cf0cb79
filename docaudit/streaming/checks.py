"""Checks as a flow: started, evaluated, and stored with scores and mistakes in one transaction, from a table or from a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docaudit.operators.report import reports, status
from docaudit.plans.profiles import MISTAKES, UNDER_WAY, Rule
from docaudit.sources.reports import STARTED, starting_checks
from docaudit.sources.versions import Transaction, VersionedTables

Facts = Callable[[DataFrame], DataFrame]


def start(store: VersionedTables, documents: DataFrame, standard_id: int = 1, key: str = "doc_id") -> None:
    """Every document gets a check that is under way and the status that goes with it, both or neither.

    Checks that are started are let in whether or not the document has one: a document may be checked again at any time.
    """
    with store.transaction() as t:
        t.append("checks", starting_checks(documents, standard_id, key).withColumn("score", F.lit(None).cast("int")))
        t.overwrite("documents", documents.select(key, F.lit(UNDER_WAY).alias("status"), F.lit(None).cast("int").alias("score")))


def evaluated(facts: DataFrame, rules: list[Rule], key: str = "doc_id") -> DataFrame:
    """Reports with their results, status and time: what is stored of a check, computed once a document."""
    return status(reports(facts, rules, (key,), nested=True)).withColumn("checked_at", F.current_timestamp())


def mistakes_of(checks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows for each failed critical or warning result of stored checks: narrow."""
    pairs = [F.lit(x) for k, v in MISTAKES.items() for x in (k, F.array(*map(F.lit, v)))]
    kind = F.create_map(*pairs)[F.col("r.severity")]
    rows = checks.select(key, F.explode("results").alias("r")).filter(~F.col("r.is_passed") & F.col("r.severity").isin(*MISTAKES))
    return rows.select(key, "r.rule_id", kind[0].alias("mistake_type"), kind[1].alias("critical_status"), F.col("r.message").alias("description"))


def _store(t: Transaction, found: DataFrame, key: str) -> DataFrame:
    """Checks are written first, and scores and mistakes made from what was written, so facts are computed once. Returns what was written."""
    counts = ["total_checks", "passed_checks", "failed_checks", "critical_issues", "warning_issues"]
    written = t.append("evaluations", found.select(key, *counts, "score", "is_compliant", "status", "checked_at", "results"))
    t.append("scores", written.select(key, "score", "status", "checked_at"))
    t.append("mistakes", mistakes_of(written, key))
    return written


def finish(store: VersionedTables, facts: DataFrame, rules: list[Rule], key: str = "doc_id") -> None:
    """Evaluates documents and stores results, scores, mistakes and statuses in one transaction: a reader sees all of it or nothing.

    Of checks under way the result and score are replaced, those that have ended stay as they are; documents without facts stay under
    way. A document has its facts once.
    """
    with store.transaction() as t:
        written = _store(t, evaluated(facts, rules, key), key)
        body = F.to_json(F.struct("total_checks", "passed_checks", "score", "is_compliant"))
        found = written.select(key, body.alias("new_result"), F.col("score").alias("new_score"), F.col("status").alias("new_status"))
        ends = (F.col("result") == STARTED) & F.col("new_result").isNotNull()
        either = lambda new, old: F.when(ends, F.col(new)).otherwise(F.col(old)).alias(old)
        t.overwrite("checks", t.read("checks").join(found, key, "left").select(key, "standart_id", "checked_at", either("new_result", "result"), either("new_score", "score")))
        t.overwrite("documents", t.read("documents").join(found, key, "left").select(key, F.coalesce("new_status", "status").alias("status"), F.coalesce("new_score", "score").alias("score")))


def check_stream(spark: SparkSession, source: str, schema, facts: Facts, rules: list[Rule], store: VersionedTables, checkpoint: str, application: str = "checks", key: str = "doc_id", per_batch: int | None = None) -> StreamingQuery:
    """A stream of document files whose results, scores and mistakes go to three tables, a version a batch.

    A batch's number is committed with its rows. A batch that comes again after a failure, whether or not the first run got as far
    as its commit, leaves its rows once. The stream ends when all files are read.
    """

    def batch(rows: DataFrame, number: int) -> None:
        with store.transaction(application, number) as t:
            if not t.done:
                _store(t, evaluated(facts(rows), rules, key), key)

    reader = spark.readStream.schema(schema)
    arriving = (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).parquet(source)
    return arriving.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
