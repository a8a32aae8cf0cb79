"""Table schemas and row expectations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TABLES = {
    "users": "user_id int, first_name string, surname_name string, patronomic_name string, email string, username string, password string, role string, is_admin boolean, tg_username string, is_tg_subscribed boolean, telegram_id bigint, theme string, is_push_enabled boolean",
    "documents": "document_id int, user_id int, filename string, filepath string, upload_datetime timestamp_ntz, doc_type string, is_example boolean, size decimal(10,2), status_id int, report_pdf_path string, score int, analysis_time decimal(7,2)",
    "standart": "standart_id int, name string, version string, description string, created_at timestamp_ntz, is_custom boolean",
    "check": "check_id int, document_id int, standart_id int, checked_at timestamp_ntz, result string, report_path string, score int",
    "reports": "report_id int, check_id int, report_json string, created_at timestamp_ntz",
    "reviews": "review_id int, user_id int, rating int, review_text string, created_at date",
    "statuses": "status_id int, status_name string",
    "mistake_types": "mistake_type_id int, mistake_type_name string",
    "mistakes": "mistake_id int, mistake_type_id int, description string, critical_status string, document_id int",
}

FACTS = "doc_id string, required_elements array<string>, font_settings struct<font_family:string,font_size:int,line_spacing:double>, page_margins struct<left:double,right:double,top:double,bottom:double>, paragraph_indent double, introduction_text string, full_text string, page_count int, word_count int"


def expectations(table: str) -> dict[str, Column]:
    """What rows of a table must satisfy."""
    own = {
        "reviews": {"rating": F.col("rating").between(1, 5)},
        "users": {"password": F.char_length("password") >= 6, "first_name": F.char_length("first_name") >= 2, "surname_name": F.char_length("surname_name") >= 2, "email": F.col("email").rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")},
        "documents": {"score": F.col("score").between(0, 100)},
    }
    return own.get(table, {})
