"""Stored results of any shape, read as VARIANT: fields that are a number in one row and a list in the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.functions.text import number_text

# What stands for a message that there is not, and for a result that cannot be read.
NO_ERROR, NO_WARNING, UNREADABLE = "Неизвестная ошибка", "Неизвестное замечание", "Ошибка чтения отчёта из БД"


def number_at(v: Column, path: str) -> Column:
    """The number at a path: a number, a numeric text or a truth value; null for lists, objects, other texts and where nothing is."""
    return F.try_variant_get(v, path, "double")


def text_at(v: Column, path: str) -> Column:
    """The text at a path; a number or truth value as JSON writes it, lists and objects too."""
    own = F.try_variant_get(v, path, "variant")
    return F.coalesce(F.try_variant_get(v, path, "string"), F.to_json(own))


def list_at(v: Column, path: str) -> Column:
    """The list at a path: an object or scalar that stands where a list should is its only item; nothing and null are no items."""
    own = F.try_variant_get(v, path, "variant")
    several = F.try_variant_get(v, path, "array<variant>")
    return F.when(several.isNotNull(), several).when(own.isNull() | F.is_variant_null(own), F.array().cast("array<variant>")).otherwise(F.array(own))


def messages(items: Column, severity: str, default: str) -> Column:
    """The messages of results of a severity, in order."""
    own = F.filter(items, lambda r: F.coalesce(F.try_variant_get(r, "$.severity", "string") == severity, F.lit(False)))
    return F.transform(own, lambda r: F.coalesce(text_at(r, "$.message"), F.lit(default)))


def stored_results(checks: DataFrame, documents: DataFrame | None = None, default_name: str = "unknown") -> DataFrame:
    """check_id, document_id, filename, readable, score, is_compliant, total_checks, passed_checks, errors, warnings of checks (check_id,
    document_id, result): one row a check, whatever its result holds.

    A result that is null or empty has no fields; one that is no JSON has the message UNREADABLE as its only error. The report is the
    object `report` of the result, or the result itself if it has none. A document's own score goes before the result's; a document
    that there is not leaves the default name. Fields of a kind that is not expected count as missing: numbers as 0, lists as
    empty, and an object where a list should be as its only item. A document's id is unique among documents.
    """
    given = F.nullif(F.trim("result"), F.lit(""))
    rows = checks.select("check_id", "document_id", given.isNotNull().alias("given"), F.try_parse_json(given).alias("v"))
    inner = F.try_variant_get("v", "$.report", "variant")
    is_object = F.coalesce(F.schema_of_variant(inner).startswith("OBJECT"), F.lit(False))
    rows = rows.withColumn("report", F.when(is_object, inner).otherwise(F.col("v"))).withColumn("items", list_at(F.col("report"), "$.results"))
    readable = ~F.col("given") | F.col("v").isNotNull()
    if documents is not None:
        rows = rows.join(documents.select("document_id", "filename", F.col("score").cast("double").alias("own_score")), "document_id", "left")
    else:
        rows = rows.withColumns({"filename": F.lit(None).cast("string"), "own_score": F.lit(None).cast("double")})
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select(
        "check_id", "document_id", F.coalesce("filename", F.lit(default_name)).alias("filename"), readable.alias("readable"), zero(F.coalesce("own_score", number_at(F.col("v"), "$.score"))).alias("score"),
        F.coalesce(F.try_variant_get("v", "$.is_compliant", "boolean"), F.lit(False)).alias("is_compliant"), zero(number_at(F.col("report"), "$.total_checks")).alias("total_checks"), zero(number_at(F.col("report"), "$.passed_checks")).alias("passed_checks"),
        F.when(~readable, F.array(F.lit(UNREADABLE))).otherwise(messages(F.col("items"), "critical", NO_ERROR)).alias("errors"), messages(F.col("items"), "warning", NO_WARNING).alias("warnings"),
    )


def shown_results(stored: DataFrame) -> DataFrame:
    """Stored results with their numbers as messages print them."""
    return stored.withColumns({c: number_text(F.col(c)) for c in ("score", "total_checks", "passed_checks")})
