"""The read endpoints of the service as SQL table functions over temporary views, with their access rules inside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docaudit.plans.profiles import PROGRESS, UNKNOWN
from docaudit.schemas import TABLES

#: Who asks: parameters that functions with access rules have last.
VIEWER = "me BIGINT, admin BOOLEAN"
OWN = "(admin OR user_id = me)"
# parameters are not known inside subqueries: those take them from the outer row, or are joins
_MISTAKES = "SELECT m.* FROM {mistakes} m JOIN {documents} d ON d.document_id = m.document_id WHERE m.document_id = wanted AND (admin OR d.user_id = me)"
_PROGRESS = f"CASE status_name {' '.join(f'WHEN {k!r} THEN {v}' for k, v in PROGRESS.items())} ELSE 0 END"
_STATUS = f"SELECT d.document_id, coalesce(s.status_name, '{UNKNOWN}') AS status, {_PROGRESS} AS progress FROM {{documents}} d LEFT JOIN {{statuses}} s ON s.status_id = d.status_id WHERE d.document_id = wanted AND d.user_id = me"
_RESULT = "SELECT c.check_id, c.document_id, coalesce(d.filename, 'unknown') AS filename, coalesce(d.score, c.score, 0) AS score, c.result FROM {check} c JOIN {documents} d ON d.document_id = c.document_id WHERE c.check_id = wanted AND (admin OR d.user_id = me)"
_FULL = f"SELECT d.document_id, d.filename, d.status_id, d.score, (SELECT count(*) FROM {{check}} c WHERE c.document_id = d.document_id) AS checks, (SELECT count(*) FROM {{mistakes}} m WHERE m.document_id = d.document_id) AS mistakes FROM {{documents}} d WHERE d.document_id = wanted AND {OWN}"
_OF_USER = "SELECT r.* FROM {reports} r JOIN {check} c ON c.check_id = r.check_id JOIN {documents} d ON d.document_id = c.document_id WHERE d.user_id = wanted AND (admin OR wanted = me)"


def _all(table: str) -> str:
    return f"SELECT * FROM {{{table}}}"


def _by(table: str, column: str) -> str:
    return f"SELECT * FROM {{{table}}} WHERE {column} = wanted"


#: Parameters and body of each function; {table} is the view of a table.
ENDPOINTS: dict[str, tuple[str, str]] = {
    "all_documents": (VIEWER, f"{_all('documents')} WHERE admin"),
    "document_by_id": (f"wanted BIGINT, {VIEWER}", f"{_by('documents', 'document_id')} AND {OWN}"),
    "documents_by_user": (f"wanted BIGINT, {VIEWER}", f"{_by('documents', 'user_id')} AND (admin OR wanted = me)"),
    "documents_by_status": ("wanted BIGINT", _by("documents", "status_id")),
    "document_full_info": (f"wanted BIGINT, {VIEWER}", _FULL),
    "gost_status": ("wanted BIGINT, me BIGINT", _STATUS),
    "gost_result": (f"wanted BIGINT, {VIEWER}", _RESULT),
    "all_checks": ("", _all("check")),
    "check_by_id": ("wanted BIGINT", _by("check", "check_id")),
    "checks_by_document": ("wanted BIGINT", _by("check", "document_id")),
    "checks_by_standard": ("wanted BIGINT", _by("check", "standart_id")),
    "all_mistakes": ("", _all("mistakes")),
    "mistake_by_id": ("wanted BIGINT", _by("mistakes", "mistake_id")),
    "mistakes_by_document": (f"wanted BIGINT, {VIEWER}", _MISTAKES),
    "mistakes_by_type": ("wanted BIGINT", _by("mistakes", "mistake_type_id")),
    "all_mistake_types": ("", _all("mistake_types")),
    "mistake_type_by_id": ("wanted BIGINT", _by("mistake_types", "mistake_type_id")),
    "all_reports": ("", _all("reports")),
    "report_by_id": ("wanted BIGINT", _by("reports", "report_id")),
    "reports_by_check": ("wanted BIGINT", _by("reports", "check_id")),
    "reports_by_user": (f"wanted BIGINT, {VIEWER}", _OF_USER),
    "all_reviews": ("", _all("reviews")),
    "review_by_id": ("wanted BIGINT", _by("reviews", "review_id")),
    "reviews_by_user": ("wanted BIGINT", _by("reviews", "user_id")),
    "all_standards": ("", _all("standart")),
    "standard_by_id": ("wanted BIGINT", _by("standart", "standart_id")),
    "standard_by_name": ("wanted STRING, wanted_version STRING", "SELECT * FROM {standart} WHERE name = wanted AND version <=> wanted_version"),
    "all_statuses": ("", _all("statuses")),
    "status_by_id": ("wanted BIGINT", _by("statuses", "status_id")),
    "all_users": (VIEWER, f"{_all('users')} WHERE admin"),
    "user_by_id": (f"wanted BIGINT, {VIEWER}", "SELECT * FROM {users} WHERE user_id = wanted AND (admin OR wanted = me)"),
}


def install(spark: SparkSession, tables: dict[str, DataFrame], prefix: str = "api_") -> None:
    """A temporary view for each table and a temporary function for each endpoint whose tables are there, all with the prefix.

    Functions are expanded where they are called, so their parameters reach the scans as filters. Without the right to see a row
    there is no row. A parameter that is null finds nothing, but for a version.
    """
    for name, rows in tables.items():
        if name not in TABLES:
            raise ValueError(f"unknown table {name}")
        rows.createOrReplaceTempView(f"{prefix}{name}")
    views = {name: f"{prefix}{name}" for name in TABLES}
    for name, (parameters, body) in ENDPOINTS.items():
        if all("{" + t + "}" not in body or t in tables for t in TABLES):
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS TABLE RETURN {body.format(**views)}")


def call(spark: SparkSession, name: str, *args, prefix: str = "api_") -> DataFrame:
    """Rows of an endpoint; arguments are bound, never pasted into the text."""
    marks = ", ".join(f":p{i}" for i in range(len(args)))
    return spark.sql(f"SELECT * FROM {prefix}{name}({marks})", args={f"p{i}": a for i, a in enumerate(args)})
