"""Reports as JSON files and JSON columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPORT = "document_id string, total_checks int, passed_checks int, failed_checks int, critical_issues int, warning_issues int, timestamp string, filename string, results array<struct<rule_id:string,section:string,title:string,severity:string,is_passed:boolean,message:string,expected_value:variant,actual_value:variant,details:struct<suggestion:string>,suggestion:string>>"
STARTED = '{"status":"analyzing"}'


def write_reports(reports: DataFrame, path: str) -> None:
    reports.write.option("ignoreNullFields", "false").json(path)


def read_reports(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    return spark.read.schema(REPORT).option("multiLine", whole_files).json(path)


def as_json(reports: DataFrame, name: str = "result") -> DataFrame:
    """All columns of a report as one JSON string, nulls kept."""
    return reports.select("doc_id", F.to_json(F.struct(*[c for c in reports.columns if c != "doc_id"]), {"ignoreNullFields": "false"}).alias(name))


def starting_checks(documents: DataFrame, standard_id: int, key: str = "document_id") -> DataFrame:
    """New checks that are under way."""
    return documents.select(key, F.lit(standard_id).alias("standart_id"), F.current_timestamp().alias("checked_at"), F.lit(STARTED).alias("result"))
