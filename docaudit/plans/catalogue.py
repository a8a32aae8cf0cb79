"""The query catalogue: every operator of the library over the given tables, with the SQL it can be held against.

orders stand for documents, customer for users, lineitem for checks and mistakes, events for status histories.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docaudit.functions import text as fn
from docaudit.operators import facts as fx
from docaudit.operators import relational as rel
from docaudit.operators import report as rp
from docaudit.operators.checks import missing_elements, missing_phrases
from docaudit.plans.profiles import ADVICE, CORPUS, DOC_TYPES, LOWEST_TIER, STANDARD, TIERS, TITLE_WORDS_PARAGRAPHS, Rule
from docaudit.sources import documents as documents_source
from docaudit.sources import rules as rules_source
from docaudit.sources.reports import as_json, read_reports, write_reports
from docaudit.sources.workspace import new_folder
from docaudit.streaming.status import arrival_reports, check_arrivals, latest_status, with_progress

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


STRIPPED = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
LINES = f"l AS (SELECT doc_id, unnest(generate_series(0, len(ls) - 1)) AS pos, unnest(ls) AS line FROM (SELECT doc_id, {STRIPPED} AS ls FROM documents))"
FACTS = rf"""facts AS (SELECT doc_id, full_text, lang, source, len(ls) AS line_count, word_count,
  list_transform(ls, lambda x: lower(string_split_regex(x, '\s+')[1])) AS elements
  FROM (SELECT doc_id, text AS full_text, lang, source, {STRIPPED} AS ls, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS word_count FROM documents))"""
RESULTS = (
    FACTS
    + """, results AS (
SELECT doc_id, 'c1_elements' AS rule_id, 'Elements ' AS section, 'critical' AS severity, len(m) = 0 AS is_passed,
  CASE WHEN len(m) = 0 THEN 'Все обязательные элементы присутствуют' ELSE 'Отсутствуют элементы: ' || array_to_string(m, ', ') END AS message,
  CASE WHEN len(m) > 0 THEN 'Добавьте недостающие элементы: ' || array_to_string(m, ', ') END AS suggestion
  FROM (SELECT *, list_filter(['the', 'licensed', 'and', 'la'], lambda e: len(list_filter(elements, lambda a: contains(a, e))) = 0) AS m FROM facts)
UNION ALL SELECT doc_id, 'c2_lines', 'Number of lines', 'warning', line_count BETWEEN 2 AND 12,
  'Значение ' || line_count || CASE WHEN line_count < 2 THEN ' меньше минимально допустимого 2' WHEN line_count > 12 THEN ' больше максимально допустимого 12' ELSE ' находится в допустимом диапазоне [2, 12]' END, NULL FROM facts
UNION ALL SELECT doc_id, 'c3_short', 'Least words', 'warning', word_count >= 60,
  'Значение ' || word_count || CASE WHEN word_count < 60 THEN ' меньше минимально допустимого 60' ELSE ' не меньше минимально допустимого 60' END, NULL FROM facts
UNION ALL SELECT doc_id, 'c4_long', 'Most words', 'info', word_count <= 2000,
  'Значение ' || word_count || CASE WHEN word_count > 2000 THEN ' больше максимально допустимого 2000' ELSE ' не больше максимально допустимого 2000' END, NULL FROM facts
UNION ALL SELECT doc_id, 'c5_phrase', 'Phrase', 'warning', contains(lower(full_text), 'the '),
  CASE WHEN contains(lower(full_text), 'the ') THEN 'Текст содержит требуемое: ''The ''' ELSE 'Текст не содержит требуемое: ''The ''' END, NULL FROM facts
UNION ALL SELECT doc_id, 'c6_language', 'Language', 'critical', lang = 'en',
  CASE WHEN lang = 'en' THEN 'Соответствует требованию: en' ELSE 'Не соответствует: ожидалось en, получено ' || lang END, NULL FROM facts
UNION ALL SELECT doc_id, 'c7_source', 'Origin', 'warning', lang = 'en' AND source = 'src0',
  CASE WHEN lang = 'en' AND source = 'src0' THEN 'Все параметры соответствуют требованиям' ELSE 'Несоответствия: ' || concat_ws('; ',
    CASE WHEN lang <> 'en' THEN 'lang: ожидалось en, получено ' || lang END, CASE WHEN source <> 'src0' THEN 'source: ожидалось src0, получено ' || source END) END, NULL FROM facts)"""
)
REPORT = (
    RESULTS
    + """, report AS (SELECT doc_id, count(*) AS total_checks, count(*) FILTER (is_passed) AS passed_checks, count(*) FILTER (NOT is_passed) AS failed_checks,
  count(*) FILTER (NOT is_passed AND severity = 'critical') AS critical_issues, count(*) FILTER (NOT is_passed AND severity = 'warning') AS warning_issues FROM results GROUP BY doc_id),
scored AS (SELECT *, round_even(passed_checks / total_checks * 100, 2) AS success_rate, CAST(round_even(passed_checks * 100 / total_checks, 0) AS INTEGER) AS score,
  passed_checks = total_checks AS is_compliant, critical_issues > 0 AS has_critical FROM report)"""
)
COLUMNS = ["doc_id", "rule_id", "section", "severity", "is_passed", "message", "suggestion"]


def corpus_facts(spark, sf_dir, rules: list[Rule]):
    """The facts that these rules name."""
    return fx.corpus_facts(t(spark, sf_dir, "documents"), [r.field for r in rules])


def results(spark, sf_dir, rules: list[Rule] = CORPUS, *severities: str) -> DataFrame:
    named = [r for r in rules if not severities or r.severity in severities]
    return rp.evaluate(corpus_facts(spark, sf_dir, named), rules, severities=severities)


def reports(spark, sf_dir, nested: bool = False) -> DataFrame:
    return rp.reports(corpus_facts(spark, sf_dir, CORPUS), CORPUS, nested=nested)


def one_rule(spark, sf_dir, rule_id: str) -> DataFrame:
    return results(spark, sf_dir, [rules_source.by_id(CORPUS, rule_id)]).select(*COLUMNS)


# Scans, projections, filters


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def scan_documents(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")


@query("SELECT o_orderkey AS document_id, o_custkey AS user_id, o_orderstatus AS status, o_totalprice AS size FROM orders")
def project_dto(spark, sf_dir):
    return t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("size"))


@query("SELECT true AS alive")
def liveness(spark, sf_dir):
    return spark.range(1).select(F.lit(True).alias("alive"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def point_lookup(spark, sf_dir):
    return rel.lookup(t(spark, sf_dir, "orders"), o_orderkey=7).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 11")
def filter_by_owner(spark, sf_dir):
    return rel.lookup(t(spark, sf_dir, "orders"), o_custkey=11).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def filter_by_status(spark, sf_dir):
    return rel.lookup(t(spark, sf_dir, "orders"), o_orderstatus="F").select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey < 2000 AND o_custkey = 11")
def owner_conjunction(spark, sf_dir):
    return t(spark, sf_dir, "orders").filter((F.col("o_orderkey") < 2000) & (F.col("o_custkey") == 11)).select("o_orderkey", "o_custkey")


@query("SELECT 'admin' AS viewer, count(*) AS n FROM orders UNION ALL SELECT 'owner', count(*) FROM orders WHERE o_custkey = 5")
def row_security(spark, sf_dir):
    own = lambda name, admin: rel.visible(t(spark, sf_dir, "orders"), 5, admin, "o_custkey").agg(F.lit(name).alias("viewer"), F.count(F.lit(1)).alias("n"))
    return own("admin", True).unionByName(own("owner", False))


@query("SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.toxic IS NOT DISTINCT FROM NULL AND d.lang = 'en'")
def null_safe_lookup(spark, sf_dir):
    joined = t(spark, sf_dir, "documents").select("doc_id", "lang").join(t(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return rel.lookup(joined, toxic=None, lang="en").select("doc_id", "toxic")


@query("SELECT min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def first_row(spark, sf_dir):
    return rel.first_by(t(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select("o_orderkey"), "o_orderkey")


# Joins


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3")
def reports_by_user(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    orders = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    return rel.through_chain(rows, orders, t(spark, sf_dir, "customer"), "l_orderkey", "c_custkey", 3, "c_nationkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_custkey = 11)")
def checks_by_user_semi(spark, sf_dir):
    orders = t(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    return rel.owned_through(t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), orders, "l_orderkey", 11, "o_custkey")


STATUS_ROWS = [("F", "Идеален"), ("O", "Анализируется")]


@query("SELECT o_orderkey, coalesce(n, 'Неизвестно') AS status_name FROM orders LEFT JOIN (VALUES ('F', 'Идеален'), ('O', 'Анализируется')) s(k, n) ON k = o_orderstatus")
def status_lookup_default(spark, sf_dir):
    statuses = spark.createDataFrame(STATUS_ROWS, "o_orderstatus string, n string")
    return rel.with_lookup(t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), statuses, "o_orderstatus", "n", "Неизвестно", "status_name").drop("o_orderstatus")


@query("SELECT o_orderkey, CAST(p AS INTEGER) AS progress, CASE WHEN p = 100 THEN 0 ELSE 30 END AS seconds_left FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 100 WHEN 'O' THEN 50 ELSE 0 END AS p FROM orders)")
def progress_map(spark, sf_dir):
    named = t(spark, sf_dir, "orders").withColumn("status", fn.looked_up(F.col("o_orderstatus"), dict(STATUS_ROWS), "Неизвестно"))
    return with_progress(named).select("o_orderkey", "progress", "seconds_left")


@query("SELECT o_orderkey, coalesce(string_agg(l_linenumber || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag), '') AS children FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def eager_children(spark, sf_dir):
    children = t(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    nested = rel.with_children(t(spark, sf_dir, "orders").select("o_orderkey"), children, "o_orderkey", "l_linenumber", ["l_returnflag"], "mistakes")
    return nested.select("o_orderkey", F.array_join(F.transform("mistakes", lambda m: F.concat_ws(":", m["l_linenumber"], m["l_returnflag"])), ",").alias("children"))


# Rule predicates


@query(f"WITH {FACTS} SELECT doc_id, array_to_string(list_filter(['the', 'licensed', 'and', 'la'], lambda e: len(list_filter(elements, lambda a: contains(a, e))) = 0), ', ') AS missing FROM facts")
def missing_elements_join(spark, sf_dir):
    return fx.corpus_facts(t(spark, sf_dir, "documents"), ["elements"]).select("doc_id", F.array_join(missing_elements(["the", "licensed", "and", "la"], F.col("elements")), ", ").alias("missing"))


@query(
    "SELECT doc_id, concat_ws(', ', CASE WHEN NOT (contains(lower(text), 'licensed under') OR contains(lower(text), 'all rights reserved')) THEN 'licensed under' END, CASE WHEN NOT (contains(lower(text), 'und der') OR contains(lower(text), 'und die')) THEN 'und der' END) AS missing FROM documents"
)
def synonym_presence(spark, sf_dir):
    missing = missing_phrases(["licensed under", "und der"], F.col("text"), {"licensed under": ["all rights reserved"], "und der": ["und die"]})
    return t(spark, sf_dir, "documents").select("doc_id", F.array_join(missing, ", ").alias("missing"))


@query(
    r"""WITH p AS (SELECT page_id, list_filter(string_split(regexp_extract(html, '<title>([^<]*)</title>', 1), ' '), lambda w: length(w) >= 6) AS big, regexp_extract_all(html, '<p[^>]*>([^<]*)</p>', 1) AS ls FROM pages)
SELECT page_id, len(ls) AS n_lines, len(list_filter(ls, lambda x: len(list_filter(big, lambda g: contains(x, g))) > 0)) AS n_headings FROM p"""
)
def heading_glyph_theta(spark, sf_dir):
    big = F.filter(F.split(F.regexp_extract("html", "<title>([^<]*)</title>", 1), " "), lambda w: F.char_length(w) >= 6)
    pages = t(spark, sf_dir, "pages").select("page_id", big.alias("big"), F.regexp_extract_all("html", F.lit("<p[^>]*>([^<]*)</p>"), F.lit(1)).alias("ls"))
    heads = F.filter("ls", lambda x: F.exists("big", lambda g: F.contains(x, g)))
    return pages.select("page_id", F.size("ls").cast("long").alias("n_lines"), F.size(heads).cast("long").alias("n_headings"))


def rule_sql(rule_id: str) -> str:
    return f"WITH {RESULTS} SELECT {', '.join(COLUMNS)} FROM results WHERE rule_id = '{rule_id}'"


@query(rule_sql("c7_source"))
def object_equals(spark, sf_dir):
    return one_rule(spark, sf_dir, "c7_source")


@query(
    f"""WITH {FACTS} SELECT doc_id, lang = 'en' AND source = 'src0' AND false AS is_passed, 'Отсутствуют или неверны свойства: ' || concat_ws(', ',
CASE WHEN lang <> 'en' THEN 'lang (неверное значение)' END, CASE WHEN source <> 'src0' THEN 'source (неверное значение)' END, 'place') AS message FROM facts"""
)
def object_contains(spark, sf_dir):
    rule = Rule("p", "4", "Properties", "formatting", "origin", {"lang": "en", "source": "src0", "place": 1}, "object_contains", "warning")
    return results(spark, sf_dir, [rule]).select("doc_id", "is_passed", "message")


@query(rule_sql("c1_elements"))
def rule_list_presence(spark, sf_dir):
    return one_rule(spark, sf_dir, "c1_elements")


@query(rule_sql("c6_language"))
def rule_equals(spark, sf_dir):
    return one_rule(spark, sf_dir, "c6_language")


@query(rule_sql("c2_lines"))
def rule_range(spark, sf_dir):
    return one_rule(spark, sf_dir, "c2_lines")


@query(rule_sql("c3_short"))
def rule_min(spark, sf_dir):
    return one_rule(spark, sf_dir, "c3_short")


@query(rule_sql("c4_long"))
def rule_max(spark, sf_dir):
    return one_rule(spark, sf_dir, "c4_long")


@query(rule_sql("c5_phrase"))
def rule_contains(spark, sf_dir):
    return one_rule(spark, sf_dir, "c5_phrase")


@query(
    """SELECT doc_id, rule_id, false AS is_passed, message, suggestion FROM documents CROSS JOIN (VALUES
('6.1.1_font', 'В документе отсутствуют настройки шрифта', 'Добавьте настройки шрифта в документ'),
('6.1.1_margins', 'В документе отсутствуют настройки полей', 'Добавьте настройки полей страницы в документ'),
('6.1.2_paragraph', 'В документе отсутствует настройка абзацного отступа', 'Установите абзацный отступ равным 1.25 см')) r(rule_id, message, suggestion)"""
)
def rule_missing_facet(spark, sf_dir):
    return results(spark, sf_dir, [r for r in STANDARD if r.rule_type == "formatting"]).select("doc_id", "rule_id", "is_passed", "message", "suggestion")


@query(f"WITH {RESULTS} SELECT {', '.join(COLUMNS)} FROM results")
def evaluate_all_rules(spark, sf_dir):
    return results(spark, sf_dir).select(*COLUMNS)


@query(f"WITH {RESULTS} SELECT {', '.join(COLUMNS)} FROM results WHERE rule_id IN ('c2_lines', 'c3_short', 'c4_long')")
def evaluate_section(spark, sf_dir):
    return results(spark, sf_dir, rules_source.by_section(CORPUS, "2")).select(*COLUMNS)


# Reports


@query(f"WITH {REPORT} SELECT * FROM scored")
def report_by_document(spark, sf_dir):
    return reports(spark, sf_dir)


@query(f"WITH {RESULTS} SELECT {', '.join(COLUMNS)} FROM results WHERE NOT is_passed")
def failed_results(spark, sf_dir):
    return rp.failed(results(spark, sf_dir)).select(*COLUMNS)


@query(f"WITH {RESULTS} SELECT {', '.join(COLUMNS)} FROM results WHERE NOT is_passed AND severity = 'critical'")
def critical_issues(spark, sf_dir):
    return rp.failed(results(spark, sf_dir, CORPUS, "critical")).select(*COLUMNS)


@query(f"WITH {RESULTS} SELECT {', '.join(COLUMNS)} FROM results WHERE severity = 'warning'")
def stored_view_by_severity(spark, sf_dir):
    return rp.by_severity(results(spark, sf_dir, CORPUS, "warning"), "warning").select(*COLUMNS)


@query(
    f"""WITH {REPORT} SELECT s.doc_id, score, string_agg(rule_id || '=' || CASE WHEN is_passed THEN '1' ELSE '0' END, ',' ORDER BY rule_no) AS outcome FROM scored s
JOIN (SELECT r.*, n.rule_no FROM results r JOIN (VALUES ('c1_elements', 0), ('c2_lines', 1), ('c3_short', 2), ('c4_long', 3), ('c5_phrase', 4), ('c6_language', 5), ('c7_source', 6)) n(rule_id, rule_no) USING (rule_id)) r ON r.doc_id = s.doc_id GROUP BY s.doc_id, score"""
)
def nested_report(spark, sf_dir):
    nested = reports(spark, sf_dir, nested=True)
    return nested.select("doc_id", "score", F.array_join(F.transform("results", lambda r: F.concat(r["rule_id"], F.lit("="), F.when(r["is_passed"], "1").otherwise("0"))), ",").alias("outcome"))


@query(f"WITH {REPORT} SELECT doc_id, total_checks, score FROM scored")
def report_json_round_trip(spark, sf_dir):
    stored = as_json(reports(spark, sf_dir))
    return stored.select("doc_id", F.from_json("result", "total_checks long, score int").alias("r")).select("doc_id", "r.*")


@query(
    f"WITH {RESULTS} SELECT doc_id, rule_id, 'Ошибка ГОСТ' AS mistake_type, 'high' AS critical_status FROM results WHERE NOT is_passed AND severity = 'critical' UNION ALL SELECT doc_id, rule_id, 'Предупреждение ГОСТ', 'low' FROM results WHERE NOT is_passed AND severity = 'warning'"
)
def fan_out_mistakes(spark, sf_dir):
    return rp.mistakes(results(spark, sf_dir, CORPUS, "critical", "warning")).select("doc_id", "rule_id", "mistake_type", "critical_status")


@query(f"WITH {REPORT} SELECT doc_id, score, CASE WHEN is_compliant THEN 'Идеален' ELSE 'Отправлен на доработку' END AS status FROM scored")
def status_transition(spark, sf_dir):
    return rp.status(reports(spark, sf_dir)).select("doc_id", "score", "status")


@query(
    f"WITH {RESULTS} SELECT doc_id, 'Ошибка' AS type, 'ГОСТ' AS category, 'Критично' AS level, '-' AS page, message AS description FROM results WHERE NOT is_passed AND severity = 'critical' UNION ALL SELECT doc_id, 'Замечание', 'ГОСТ', 'Средний', '-', message FROM results WHERE NOT is_passed AND severity = 'warning'"
)
def issue_union(spark, sf_dir):
    return rp.issue_rows(results(spark, sf_dir, CORPUS, "critical", "warning"))


@query(
    f"WITH {RESULTS} SELECT doc_id, section, suggestion, severity FROM results WHERE NOT is_passed AND suggestion IS NOT NULL UNION ALL SELECT doc_id, 'Общие', s, 'info' FROM documents CROSS JOIN (VALUES "
    + ", ".join(f"('{a}')" for a in ADVICE)
    + ") v(s)"
)
def recommendations(spark, sf_dir):
    return rp.recommendations(results(spark, sf_dir)).drop("place")


@query(
    """SELECT event_id AS check_id, coalesce(c_name, 'unknown') AS filename, CASE WHEN ok THEN k ELSE 0 END AS total_checks, coalesce(c_nationkey, CASE WHEN ok THEN 7 END, 0) AS score, CASE WHEN ok THEN 1 ELSE 0 END AS n_critical
FROM (SELECT event_id, user_id, event_id % 2 = 0 AS ok, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events) LEFT JOIN customer ON c_custkey = user_id"""
)
def json_result_view(spark, sf_dir):
    body = F.concat(F.lit('{"total_checks":'), F.get_json_object("props", "$.k"), F.lit(',"score":7,"results":[{"rule_id":"r","severity":"critical","is_passed":true},{"rule_id":"s","severity":"warning"}]}'))
    checks = t(spark, sf_dir, "events").select(F.col("event_id").alias("check_id"), F.col("user_id").alias("document_id"), F.when(F.col("event_id") % 2 == 0, body).otherwise("{broken").alias("result"))
    documents = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_name").alias("filename"), F.col("c_nationkey").alias("score"))
    return rp.result_view(checks, documents).select("check_id", "filename", "total_checks", "score", F.size("critical_issues").alias("n_critical"))


@query("SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), 0) AS k, TRY_CAST(event_type AS INTEGER) IS NULL AS bad FROM events")
def json_bad_rows(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(0)).alias("k"), F.col("event_type").try_cast("int").isNull().alias("bad"))


# Aggregations and sequences


@query(f"WITH {LINES}, c AS (SELECT doc_id, length(line) AS n, count(*) AS k, min(pos) AS p FROM l GROUP BY 1, 2) SELECT doc_id, n AS modal_length FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, p) AS r FROM c) WHERE r = 1")
def mode_first_seen(spark, sf_dir):
    rows = fx.lines_of(t(spark, sf_dir, "documents")).withColumn("n", F.char_length("line").cast("long"))
    return fx.mode_first_seen(rows, ["doc_id"], "n", "pos", "modal_length")


@query("SELECT l_suppkey, round(avg(m), 4) AS mean FROM (SELECT l_suppkey, l_orderkey, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def two_level_mean(spark, sf_dir):
    inner = t(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.avg("l_extendedprice").alias("m"))
    return inner.groupBy("l_suppkey").agg(fn.half_up(F.avg("m"), 4).alias("mean"))


@query("SELECT l_orderkey, min(l_quantity) FILTER (l_returnflag <> 'N') AS low, max(l_quantity) FILTER (l_returnflag <> 'N') AS high, min(l_discount) AS bottom, max(l_discount) AS top FROM lineitem GROUP BY 1")
def min_max_margins(spark, sf_dir):
    ink = F.when(F.col("l_returnflag") != "N", F.col("l_quantity"))
    return t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(ink).alias("low"), F.max(ink).alias("high"), F.min("l_discount").alias("bottom"), F.max("l_discount").alias("top"))


@query(r"SELECT doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS words FROM documents")
def word_count(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", fn.word_count(F.col("text")).alias("words"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS tokens FROM documents")
def token_count(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", fn.token_count(F.col("text")).alias("tokens"))


def _quoted(value) -> str:
    return "NULL" if value is None else str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"


RULE_ROWS = "r(rule_no, id, section, title, type, severity, check_type, description, expected_value) AS (VALUES " + ", ".join(
    "(" + ", ".join(map(_quoted, (i, r.id, r.section, r.title, r.rule_type, r.severity, r.check_type, r.description or "", json.dumps(r.expected_value, ensure_ascii=False)))) + ")" for i, r in enumerate(STANDARD)
) + ")"


@query(
    f"WITH {RULE_ROWS} SELECT count(*) AS total_rules, count(*) FILTER (type = 'structure') AS structure, count(*) FILTER (type = 'formatting') AS formatting, count(*) FILTER (type = 'content') AS content, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info FROM r"
)
def rules_summary(spark, sf_dir):
    return rules_source.summary(rules_source.rules_frame(spark, STANDARD))


@query(f"WITH {RULE_ROWS} SELECT section, string_agg(id || '/' || severity, ',' ORDER BY rule_no) AS rules FROM r GROUP BY section")
def rules_by_section(spark, sf_dir):
    grouped = rules_source.grouped(rules_source.rules_frame(spark, STANDARD))
    return grouped.select("section", F.array_join(F.transform("rules", lambda r: F.concat_ws("/", r["id"], r["severity"])), ",").alias("rules"))


@query(f"WITH {RULE_ROWS} SELECT id, section, title, description, type, severity, check_type, expected_value FROM r")
def exported_rules(spark, sf_dir):
    return rules_source.exported(rules_source.rules_frame(spark, STANDARD))


@query("SELECT c_custkey AS user_id, count(o_orderkey) AS documents_count, round(coalesce(sum(o_totalprice), 0), 2) AS total_size FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def user_stats(spark, sf_dir):
    own = t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("m"))
    joined = t(spark, sf_dir, "customer").join(own, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select(F.col("c_custkey").alias("user_id"), F.coalesce("n", F.lit(0)).alias("documents_count"), fn.half_up(F.coalesce("m", F.lit(0.0)), 2).alias("total_size"))


@query(
    rf"""WITH {LINES}, h AS (SELECT doc_id, trim(regexp_replace(lower(line), '^\d+\.?\s*', '')) AS e, min(pos) AS p FROM l WHERE (length(line) < 50 AND upper(line) = line AND lower(line) <> line) OR regexp_matches(line, '^\d+\.?\s') GROUP BY 1, 2)
SELECT doc_id, string_agg(e, '|' ORDER BY p) AS headings FROM h GROUP BY 1"""
)
def ordered_distinct_headings(spark, sf_dir):
    heads = fx.lines_of(t(spark, sf_dir, "documents")).filter(fx.text_heading(F.col("line"))).withColumn("e", fn.strip(fn.without_number(F.lower("line"))))
    return fx.ordered_distinct(heads, ["doc_id"], "e", "pos", "h").select("doc_id", F.array_join("h", "|").alias("headings"))


@query(
    f"""WITH {LINES}, s AS (SELECT *, last_value(CASE WHEN contains(lower(line), 'licensed') THEN true WHEN length(line) < 60 THEN false END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS st FROM l)
SELECT doc_id, pos, line FROM s WHERE st"""
)
def intro_capture(spark, sf_dir):
    rows = fx.lines_of(t(spark, sf_dir, "documents")).withColumn("pos", F.col("pos").cast("long"))
    return fx.capture(rows, ["doc_id"], "pos", F.contains(F.lower("line"), F.lit("licensed")), F.char_length("line") < 60)


INTRO = r"(?s)(licensed|copyright)(.*?)(\.|rights)"


@query(rf"SELECT doc_id, CASE WHEN regexp_matches(lower(text), '{INTRO}') THEN regexp_replace(regexp_extract(lower(text), '{INTRO}', 2), '^\s+|\s+$', '', 'g') ELSE substring(text, 1, 100) END AS intro FROM documents")
def intro_regex(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", fx.introduction_of(F.col("text"), INTRO, 100).alias("intro"))


@query(rf"SELECT doc_id, CASE WHEN regexp_matches(lower(text), '{INTRO}') THEN regexp_replace(regexp_extract(lower(text), '{INTRO}', 2), '^\s+|\s+$', '', 'g') ELSE substring(text, 1, 1000) END AS introduction FROM documents")
def introduction_or_start(spark, sf_dir):
    """As intro_regex, with the fallback of 1000 characters that introductions have unless told otherwise."""
    return t(spark, sf_dir, "documents").select("doc_id", fx.introduction_of(F.col("text"), INTRO).alias("introduction"))


@query("WITH g AS (SELECT l_orderkey, v - lead(v) OVER (PARTITION BY l_orderkey ORDER BY v DESC) AS gap FROM (SELECT DISTINCT l_orderkey, l_quantity AS v FROM lineitem)) SELECT l_orderkey, count(*) AS n, sum(gap) AS total FROM g WHERE gap > 0.5 * 10 AND gap < 3 * 10 GROUP BY 1")
def gap_distinct_desc(spark, sf_dir):
    gaps = fx.gaps_descending(t(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity"), ["l_orderkey"], "l_quantity")
    return gaps.filter((F.col("gap") > 0.5 * 10) & (F.col("gap") < 3 * 10)).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("gap").alias("total"))


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
w AS (SELECT user_id, r, s AS anchor, 1 AS n, event_id AS total FROM e WHERE r = 1
UNION ALL SELECT e.user_id, e.r, CASE WHEN e.s - anchor > 86400000000 THEN e.s ELSE anchor END, CASE WHEN e.s - anchor > 86400000000 THEN n + 1 ELSE n END, CASE WHEN e.s - anchor > 86400000000 THEN total + e.event_id ELSE total END FROM w JOIN e ON e.user_id = w.user_id AND e.r = w.r + 1)
SELECT user_id, CAST(n AS INTEGER) AS sessions, CAST(total AS BIGINT) AS start_ids FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY r DESC) AS z FROM w) WHERE z = 1"""
)
def anchored_sessions(spark, sf_dir):
    events = t(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("s"), "event_id")
    starts = fx.anchored_starts(events, "user_id", "s", "event_id", 86_400_000_000)
    return starts.groupBy("user_id").agg(F.count(F.lit(1)).cast("int").alias("sessions"), F.sum("event_id").alias("start_ids"))


# Writes


@query("SELECT s AS status_name FROM (VALUES ('F'), ('O'), ('P'), ('X'), ('Y')) v(s) WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = s)")
def seed_missing_statuses(spark, sf_dir):
    wanted = spark.createDataFrame([(x,) for x in "FOPXY"], "status_name string")
    have = t(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status_name")).distinct()
    return rel.insertable(wanted, have, ["status_name"])


@query("SELECT n_name AS name, CAST(n_nationkey AS BIGINT) AS id FROM nation UNION ALL SELECT s, (SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY s) FROM (VALUES ('AAA'), ('ZZZ')) v(s)")
def get_or_create(spark, sf_dir):
    nation = t(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("id"))
    wanted = spark.createDataFrame([("ZZZ",), ("AAA",)], "name string").unionByName(nation.limit(1).select("name"))
    return rel.get_or_create(nation, wanted, "name", "id")


NEW_PAIRS = "SELECT l_orderkey AS document_id, l_linenumber AS kind FROM lineitem"


@query("SELECT o_orderkey AS document_id, 1 AS kind FROM orders UNION ALL SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_linenumber = 1 AND EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey))")
def unique_append(spark, sf_dir):
    old = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.lit(1).alias("kind"))
    new = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("kind"))
    return rel.append_unique(old, new, ["document_id", "kind"])


@query("SELECT l_orderkey AS document_id, l_linenumber AS kind FROM lineitem WHERE l_linenumber = 1 AND EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)")
def unique_append_rejects(spark, sf_dir):
    old = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.lit(1).alias("kind"))
    new = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("kind"))
    return rel.rejected(new, old, ["document_id", "kind"])


CHANGES = "(SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'X' END AS st, o_totalprice + 1 AS pr, o_orderkey % 6 = 0 AS both_ FROM orders WHERE o_orderkey % 2 = 0)"


def _changes(spark, sf_dir):
    orders = t(spark, sf_dir, "orders").filter("o_orderkey % 2 = 0")
    return orders.select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, "X").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"), F.when(F.col("o_orderkey") % 6 == 0, F.array(F.lit("o_orderstatus"), F.lit("o_totalprice"))).otherwise(F.array(F.lit("o_orderstatus"))).alias("set_columns"))


@query(f"SELECT o_orderkey, CASE WHEN k IS NULL THEN o_orderstatus ELSE st END AS o_orderstatus, CASE WHEN k IS NULL THEN o_totalprice ELSE pr END AS o_totalprice FROM orders LEFT JOIN {CHANGES} ON k = o_orderkey")
def upsert_full(spark, sf_dir):
    table = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return rel.update(table, _changes(spark, sf_dir), "o_orderkey", ["o_orderstatus", "o_totalprice"])


@query(f"SELECT o_orderkey, CASE WHEN k IS NULL THEN o_orderstatus ELSE st END AS o_orderstatus, CASE WHEN both_ THEN pr ELSE o_totalprice END AS o_totalprice FROM orders LEFT JOIN {CHANGES} ON k = o_orderkey")
def upsert_sparse(spark, sf_dir):
    table = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return rel.update_sparse(table, _changes(spark, sf_dir), "o_orderkey", ["o_orderstatus", "o_totalprice"])


@query("SELECT c_custkey, CASE WHEN c_custkey = 4 THEN true ELSE false END AS is_tg_subscribed FROM customer")
def single_column_update(spark, sf_dir):
    return rel.set_where(t(spark, sf_dir, "customer").select("c_custkey", F.lit(False).alias("is_tg_subscribed")), "is_tg_subscribed", True, F.col("c_custkey") == 4)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (3, 4, 5)")
def delete_by_key(spark, sf_dir):
    return rel.delete(t(spark, sf_dir, "orders").select("o_orderkey"), spark.range(3, 6).select(F.col("id").alias("o_orderkey")), "o_orderkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey < 20)")
def cascade_delete(spark, sf_dir):
    customers = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return rel.delete_cascading(t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), customers, customers.filter("o_custkey < 20"), "o_custkey").select("o_orderkey", "o_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey < 50 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def restricted_delete(spark, sf_dir):
    wanted = t(spark, sf_dir, "customer").filter("c_custkey < 50").select("c_custkey")
    return rel.restricted(wanted, t(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query("SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN NOT (l_quantity BETWEEN 1 AND 45) THEN 'quantity' END, CASE WHEN NOT (l_discount <= 0.08) THEN 'discount' END) AS broken FROM lineitem WHERE NOT (l_quantity BETWEEN 1 AND 45) OR NOT (l_discount <= 0.08)")
def row_expectations(spark, sf_dir):
    bad = rel.violations(t(spark, sf_dir, "lineitem"), {"quantity": F.col("l_quantity").between(1, 45), "discount": F.col("l_discount") <= 0.08})
    return bad.select("l_orderkey", "l_linenumber", F.array_join("violations", ",").alias("broken"))


# Views


@query(r"SELECT page_id, coalesce(nullif(regexp_replace('17_ab12_' || regexp_replace(url, '^[a-z]+://', ''), '^\d+_[a-f0-9]+_', ''), ''), 'Документ') AS name FROM pages")
def clean_filename(spark, sf_dir):
    stored = F.concat(F.lit("17_ab12_"), F.regexp_replace("url", "^[a-z]+://", ""))
    return t(spark, sf_dir, "pages").select("page_id", fn.display_name(stored, "Документ").alias("name"))


@query("SELECT c_custkey, least(greatest(c_acctbal / 1000, 0), 10) AS score, round(least(greatest(c_acctbal / 1000, 0), 10) * 10, 1) AS percent FROM customer")
def clamp_score(spark, sf_dir):
    s = fn.clamp(F.col("c_acctbal") / 1000, 0.0, 10.0)
    return t(spark, sf_dir, "customer").select("c_custkey", s.alias("score"), fn.half_up(s * 10, 1).alias("percent"))


@query(f"SELECT c_custkey, CASE WHEN c_acctbal / 1000 >= 8 THEN '{TIERS[0][1]}' WHEN c_acctbal / 1000 >= 5 THEN '{TIERS[1][1]}' ELSE '{LOWEST_TIER}' END AS advice FROM customer")
def recommendation_tier(spark, sf_dir):
    return t(spark, sf_dir, "customer").select("c_custkey", fn.tiered(F.col("c_acctbal") / 1000, TIERS, LOWEST_TIER).alias("advice"))


@query("SELECT c_custkey, CASE lower(c_mktsegment) WHEN 'building' THEN 'MASTER_THESIS' WHEN 'machinery' THEN 'SPECIALIST_THESIS' ELSE 'COURSE_WORK' END AS code FROM customer")
def doc_type_map(spark, sf_dir):
    words = F.when(F.lower("c_mktsegment") == "building", "master").when(F.lower("c_mktsegment") == "machinery", "дипломная").otherwise(F.lower("c_mktsegment"))
    return t(spark, sf_dir, "customer").select("c_custkey", fn.looked_up(words, DOC_TYPES, "COURSE_WORK").alias("code"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name || '@x' ELSE c_name || ' ' || c_mktsegment END AS full_name, upper(substring(c_name, 1, 1) || substring(c_mktsegment, 1, 1)) AS initials FROM customer")
def full_name(spark, sf_dir):
    none = F.col("c_custkey") % 3 == 0
    first, last = F.when(~none, F.col("c_name")), F.when(none, "").otherwise(F.col("c_mktsegment"))
    return t(spark, sf_dir, "customer").select("c_custkey", fn.full_name(first, last, F.concat("c_name", F.lit("@x"))).alias("full_name"), fn.initials(F.col("c_name"), F.col("c_mktsegment")).alias("initials"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id")
def latest_status_by_user(spark, sf_dir):
    return latest_status(t(spark, sf_dir, "events"), "user_id", "ts", "event_id", "event_type")




# Facts of documents given as paragraphs, and as pages and glyphs

PARAGRAPHS = rf"""{LINES}, p AS (SELECT doc_id, pos, length(line) AS n, CASE pos WHEN 0 THEN 'Курсовая работа ' || line WHEN 1 THEN 'Введение' WHEN 3 THEN '1. ' || line ELSE line END AS t FROM l),
h AS (SELECT *, lower(t) AS low, (pos = 1 OR n % 17 = 0 OR (length(t) < 50 AND upper(t) = t AND lower(t) <> t) OR regexp_matches(t, '^\d+\.?\s')) AS heading, trim(regexp_replace(lower(t), '^\d+\.?\s*', '')) AS clean FROM p)"""


def paragraphs_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paragraphs and sections made of the lines of plain texts."""
    n = F.char_length("line")
    text = F.when(F.col("pos") == 0, F.concat(F.lit("Курсовая работа "), "line")).when(F.col("pos") == 1, "Введение").when(F.col("pos") == 3, F.concat(F.lit("1. "), "line")).otherwise(F.col("line"))
    name = F.when(n % 4 == 0, "Arial").when(n % 4 == 1, "Times New Roman").when(n % 4 == 2, "")
    run = lambda bold, font, size: F.struct(bold.alias("bold"), font.alias("font_name"), size.cast("double").alias("size_pt"))
    runs = F.array(run(F.when(n % 17 == 0, True).when(n % 3 == 0, F.lit(None)).otherwise(False), name, F.when(n % 5 == 0, 0).otherwise(10 + n % 3)), run(F.lit(None).cast("boolean"), F.lit("Times New Roman"), F.lit(14)))
    rows = fx.lines_of(docs).select(
        "doc_id", F.col("pos").alias("para_num"), text.alias("text"), F.when(F.col("pos") == 1, "Heading 1").otherwise("Normal").alias("style_name"), runs.alias("runs"),
        F.when(n % 3 == 1, 1.5).when(n % 3 == 2, 1.0).alias("line_spacing"), F.when(n % 4 == 0, -1.0).when(n % 4 == 1, 1.25).when(n % 4 == 2, 0.5).alias("first_line_indent_cm"),
    )
    margins = [F.struct(F.lit(i).alias("section_num"), *[F.lit(v).cast("double").alias(f"{side}_mm") if v is not None else (20.04 + F.col("n_chars") % 10).alias(f"{side}_mm") for side, v in zip(("left", "right", "top", "bottom"), values, strict=True)]) for i, values in enumerate(((None, 15, 0, 20), (1, 1, 1, 1)))]
    return rows, docs.select("doc_id", F.inline(F.array(*margins)))


def _mode_sql(value: str, source: str) -> str:
    return f"(SELECT doc_id, v FROM (SELECT doc_id, v, row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, f) AS r FROM (SELECT doc_id, v, count(*) AS k, min(pl) AS f FROM (SELECT doc_id, {value} AS v, pl FROM {source}) WHERE v IS NOT NULL GROUP BY 1, 2)) WHERE r = 1)"


RUNS_SQL = "(SELECT doc_id, n, pos * 2 AS pl, 1 AS own FROM p UNION ALL SELECT doc_id, n, pos * 2 + 1, 0 FROM p)"
TITLED = " OR ".join(f"contains(low, '{w}')" for w in TITLE_WORDS_PARAGRAPHS)


@query(
    rf"""WITH {PARAGRAPHS}, e AS (SELECT doc_id, element, min(pl) AS pl FROM (SELECT doc_id, clean AS element, CAST(pos AS DOUBLE) AS pl FROM h WHERE heading UNION ALL SELECT doc_id, 'титульный лист', pos + 0.5 FROM h WHERE pos < 50 AND ({TITLED})) GROUP BY 1, 2),
s AS (SELECT *, last_value(CASE WHEN contains(low, 'введение') THEN true WHEN heading AND clean <> 'введение' THEN false END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS st FROM h),
x AS (SELECT doc_id, string_agg(t, ' ' ORDER BY pos) || ' ' AS full_text, coalesce(string_agg(t, ' ' ORDER BY pos) FILTER (st), '') AS introduction, sum(len(list_filter(string_split_regex(t, '\s+'), lambda w: w <> ''))) AS words, bool_or(heading AND regexp_matches(t, '^\d+\.')) AS chapters FROM s GROUP BY 1),
g AS (SELECT doc_id, string_agg(element, '|' ORDER BY pl) AS elements FROM e GROUP BY 1)
SELECT d.doc_id, concat_ws('|', elements, CASE WHEN chapters THEN 'основная часть' END) AS elements, f.v AS font_family, CAST(round_even(z.v, 0) AS INTEGER) AS font_size, b.v AS line_spacing, i.v AS indent, CAST(round_even(20.04 + n_chars % 10, 1) AS DOUBLE) AS left_margin,
CAST(NULL AS DOUBLE) AS top_margin, 2 AS page_count, coalesce(full_text, '') AS full_text, coalesce(introduction, '') AS introduction, CAST(coalesce(words, 0) AS INTEGER) AS word_count FROM documents d LEFT JOIN x USING (doc_id) LEFT JOIN g USING (doc_id)
LEFT JOIN {_mode_sql("CASE WHEN own = 0 THEN 'Times New Roman' ELSE CASE n % 4 WHEN 0 THEN 'Arial' WHEN 1 THEN 'Times New Roman' END END", RUNS_SQL)} f USING (doc_id)
LEFT JOIN {_mode_sql("CASE WHEN own = 0 THEN 14 WHEN n % 5 <> 0 THEN 10 + n % 3 END", RUNS_SQL)} z USING (doc_id)
LEFT JOIN {_mode_sql("CASE n % 3 WHEN 1 THEN 1.5::DOUBLE WHEN 2 THEN 1.0::DOUBLE END", "(SELECT doc_id, n, pos AS pl FROM p)")} b USING (doc_id)
LEFT JOIN {_mode_sql("CASE n % 4 WHEN 1 THEN 1.25::DOUBLE WHEN 2 THEN 0.5::DOUBLE END", "(SELECT doc_id, n, pos AS pl FROM p)")} i USING (doc_id)"""
)
def paragraph_facts(spark, sf_dir):
    facts = fx.paragraph_facts(*paragraphs_of(t(spark, sf_dir, "documents")))
    return facts.select(
        "doc_id", F.array_join("required_elements", "|").alias("elements"), "font_settings.*", F.col("paragraph_indent").alias("indent"), F.col("page_margins.left").alias("left_margin"), F.col("page_margins.top").alias("top_margin"),
        "page_count", "full_text", F.col("introduction_text").alias("introduction"), "word_count",
    )


@query(f"WITH {PARAGRAPHS} SELECT doc_id, bool_or(pos < 50 AND ({TITLED})) AS has_title, bool_or(heading AND clean = 'введение') AS has_introduction FROM h GROUP BY 1")
def title_and_introduction(spark, sf_dir):
    facts = fx.paragraph_facts(*paragraphs_of(t(spark, sf_dir, "documents"))).filter("word_count > 0")
    return facts.select("doc_id", F.array_contains("required_elements", "титульный лист").alias("has_title"), F.array_contains("required_elements", "введение").alias("has_introduction"))


GLYPHS = """g AS (SELECT l_orderkey AS doc_id, 1 + l_linenumber % 2 AS page_num, l_linenumber * 10 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS char_num,
CASE WHEN l_returnflag = 'N' THEN ' ' ELSE l_returnflag END AS text, 'ABCDEF+' || CASE l_partkey % 3 WHEN 0 THEN 'Arial-Bold' WHEN 1 THEN 'Times-Italic' ELSE 'Arial' END AS fontname, 8 + l_quantity % 7 AS size,
CAST(l_suppkey AS DOUBLE) AS x0, l_suppkey + 5.5 AS x1, CAST(l_partkey % 70 * 10 AS DOUBLE) AS y0, l_partkey % 70 * 10 + 8 + l_quantity % 7 AS y1 FROM lineitem)"""
PAGE_TEXTS = {1: "Курсовая работа\nВведение\nобычная строка\n1. Глава один", 2: "  \nЗаключение\nстудент A R\nСписок литературы"}


def glyphs_of(lineitem: DataFrame, n_lines: int) -> DataFrame:
    """Pages and glyphs made of that many order lines, as rows of one table, dealt by document."""
    order = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice")
    page = (1 + F.col("l_linenumber") % 2).cast("int")
    font = F.when(F.col("l_partkey") % 3 == 0, "Arial-Bold").when(F.col("l_partkey") % 3 == 1, "Times-Italic").otherwise("Arial")
    size, y0 = 8 + F.col("l_quantity") % 7, (F.col("l_partkey") % 70 * 10).cast("double")
    names, kinds = fx.PAGE_ROWS.split(", ")[2:], ["int", "int", "string", "string", *["double"] * 5, "string", "double", "double"]
    glyph = [F.lit(1), F.col("l_linenumber") * 10 + F.col("n"), F.when(F.col("l_returnflag") == "N", " ").otherwise(F.col("l_returnflag")), F.concat(F.lit("ABCDEF+"), font), size, F.col("l_suppkey"), F.col("l_suppkey") + 5.5, y0, y0 + size, *[F.lit(None)] * 3]
    sheet = [F.lit(0), *[F.lit(None)] * 8, F.when(F.col("page_num") == 1, PAGE_TEXTS[1]).otherwise(PAGE_TEXTS[2]), F.lit(595.0), F.lit(842.0)]
    row = lambda values: F.struct(*[v.cast(kind).alias(name) for v, kind, name in zip(values, kinds, names, strict=True)])
    # a page comes with its first line; both numberings find the rows where the first exchange has put them
    lines = fx.dealt(lineitem, n_lines, "l_orderkey").withColumn("page_num", page).withColumn("n", F.row_number().over(order)).withColumn("of_page", F.row_number().over(Window.partitionBy("l_orderkey", "page_num").orderBy("l_linenumber", "n")))
    return lines.select(F.col("l_orderkey").alias("doc_id"), "page_num", F.inline(F.when(F.col("of_page") == 1, F.array(row(glyph), row(sheet))).otherwise(F.array(row(glyph)))))


@query(
    rf"""WITH RECURSIVE {GLYPHS}, o AS (SELECT doc_id, page_num, avg(size) AS a FROM g GROUP BY 1, 2),
ink AS (SELECT *, regexp_replace(regexp_replace(fontname, '^[A-Z]{{6}}\+', ''), '-(Regular|Bold|Italic|BoldItalic)$', '') AS font FROM g WHERE trim(text) <> ''),
big AS (SELECT DISTINCT doc_id, page_num, text FROM g JOIN o USING (doc_id, page_num) WHERE size > a + 1),
t AS (SELECT DISTINCT doc_id, page_num FROM g),
ls AS (SELECT doc_id, 1 AS page_num, u.* FROM t, (VALUES (0, 'Курсовая работа'), (1, 'Введение'), (2, 'обычная строка'), (3, '1. Глава один')) u(pos, line) WHERE page_num = 1
       UNION ALL SELECT doc_id, 2, u.* FROM t, (VALUES (0, 'Заключение'), (1, 'студент A R'), (2, 'Список литературы')) u(pos, line) WHERE page_num = 2),
hd AS (SELECT doc_id, regexp_replace(lower(line), '^\d+\.?\s*', '') AS e, min(page_num * 100 + pos) AS pl FROM ls WHERE regexp_matches(lower(line), '^(введение|заключение|список литературы|\d+\.?\s?[\p{{L}}\p{{N}}_]+)') OR EXISTS (SELECT 1 FROM big WHERE big.doc_id = ls.doc_id AND big.page_num = ls.page_num AND contains(line, big.text)) GROUP BY 1, 2
       UNION ALL SELECT doc_id, 'титульный лист', 199 FROM t WHERE page_num = 1),
el AS (SELECT doc_id, string_agg(e, '|' ORDER BY pl) || CASE WHEN bool_or(e = 'глава один') THEN '|основная часть' ELSE '' END AS elements FROM hd GROUP BY 1),
f AS (SELECT doc_id, font FROM (SELECT doc_id, font, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(page_num * 1000 + char_num)) AS r FROM ink GROUP BY 1, 2) WHERE r = 1),
z AS (SELECT doc_id, s FROM (SELECT doc_id, size AS s, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(page_num * 1000 + char_num)) AS r FROM ink GROUP BY 1, 2) WHERE r = 1),
yy AS (SELECT doc_id, page_num, y0 - lead(y0) OVER (PARTITION BY doc_id, page_num ORDER BY y0 DESC) AS gap FROM (SELECT DISTINCT doc_id, page_num, y0 FROM g)),
gp AS (SELECT doc_id, avg(gap) AS gap FROM yy JOIN o USING (doc_id, page_num) WHERE gap > 0.5 * a AND gap < 3 * a GROUP BY 1),
q AS (SELECT doc_id, page_num, y1, x0, size, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY -y1, x0, size) AS r FROM g),
w AS (SELECT doc_id, page_num, r, y1 AS anchor, x0, size, true AS first FROM q WHERE r = 1
      UNION ALL SELECT q.doc_id, q.page_num, q.r, CASE WHEN abs(q.y1 - anchor) > 0.5 * a THEN q.y1 ELSE anchor END, q.x0, q.size, abs(q.y1 - anchor) > 0.5 * a FROM w JOIN q ON q.doc_id = w.doc_id AND q.page_num = w.page_num AND q.r = w.r + 1 JOIN o ON o.doc_id = q.doc_id AND o.page_num = q.page_num),
ind AS (SELECT doc_id, avg(x) AS x FROM (SELECT doc_id, page_num, avg(x0) AS x FROM w JOIN o USING (doc_id, page_num) WHERE first AND size <= a + 1 GROUP BY 1, 2) GROUP BY 1),
bx AS (SELECT doc_id, min(x0) FILTER (trim(text) <> '') AS x0, max(x1) FILTER (trim(text) <> '') AS x1, min(y0) AS y0, max(y1) AS y1 FROM g GROUP BY 1)
SELECT n.doc_id, elements, font AS font_family, CAST(round_even(s, 0) AS INTEGER) AS font_size, round_even(gap / coalesce(s, 14), 1) AS line_spacing, greatest(round_even(bx.x0 * 0.3528::DOUBLE, 1), 0) AS left_margin, greatest(round_even((595 - bx.x1) * 0.3528::DOUBLE, 1), 0) AS right_margin,
greatest(round_even((842 - bx.y1) * 0.3528::DOUBLE, 1), 0) AS top_margin, greatest(round_even(bx.y0 * 0.3528::DOUBLE, 1), 0) AS bottom_margin, round_even((ind.x - bx.x0) / 28.346::DOUBLE, 2) AS indent, page_count, CAST(8 * ones + 6 * (page_count - ones) AS INTEGER) AS word_count
FROM (SELECT doc_id, CAST(count(*) AS INTEGER) AS page_count, count(*) FILTER (page_num = 1) AS ones FROM t GROUP BY 1) n LEFT JOIN el USING (doc_id) LEFT JOIN f USING (doc_id) LEFT JOIN z USING (doc_id) LEFT JOIN gp USING (doc_id) LEFT JOIN ind USING (doc_id) LEFT JOIN bx USING (doc_id)"""
)
def page_facts(spark, sf_dir):
    lines = t(spark, sf_dir, "lineitem")
    n = lines.count()
    facts = fx.facts_of_page_rows(glyphs_of(lines, n), by_document=True, n_rows=n)
    margins = [F.col(f"page_margins.{side}").alias(f"{side}_margin") for side in ("left", "right", "top", "bottom")]
    return facts.select("doc_id", F.array_join("required_elements", "|").alias("elements"), "font_settings.*", *margins, F.col("paragraph_indent").alias("indent"), "page_count", "word_count")


# Further scalars, sources and sinks


@query("SELECT p_partkey, CASE WHEN length(p_type) > 20 THEN substring(p_type, 1, 20) || '...' ELSE p_type END AS short, round_even(p_size * 0.3528::DOUBLE, 4) AS mm, round_even(p_size / 28.346::DOUBLE, 4) AS cm, round_even(p_size * 1000 / 36000::DOUBLE, 4) AS from_emu, abs(p_size - 25) AS off FROM part")
def short_and_measured(spark, sf_dir):
    size = F.col("p_size")
    return t(spark, sf_dir, "part").select(
        "p_partkey", fn.truncated(F.col("p_type"), 20).alias("short"), F.bround(fn.points_to_mm(size), 4).alias("mm"), F.bround(fn.points_to_cm(size), 4).alias("cm"), F.bround(fn.emu_to_mm(size * 1000), 4).alias("from_emu"), F.abs(size - 25).alias("off")
    )


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_brand ELSE p_brand || CASE p_size % 3 WHEN 1 THEN '' ELSE '-Semi' END END AS font FROM part")
def clean_fonts(spark, sf_dir):
    style = F.when(F.col("p_size") % 3 == 0, "-BoldItalic").when(F.col("p_size") % 3 == 1, "").otherwise("-Semi")
    return t(spark, sf_dir, "part").select("p_partkey", fn.clean_font_name(F.concat(F.lit("QWERTY+"), "p_brand", style)).alias("font"))


@query("SELECT page_id, true AS well_formed, regexp_extract(lower(url), '[.][^./]+$') AS suffix FROM pages")
def unique_names(spark, sf_dir):
    name = fn.unique_name(F.lit("a.pdf"))
    return t(spark, sf_dir, "pages").select("page_id", name.rlike(r"^\d{9,}_[0-9a-f]{8}_a\.pdf$").alias("well_formed"), fn.suffix(F.col("url")).alias("suffix"))


@query(
    "SELECT event_id, concat_ws(chr(10), 'k=' || json_extract_string(props, '$.k'), 'type=' || event_type) AS signed, sha256(event_type) AS plain, 'doc_' || strftime(ts, '%Y%m%d_%H%M%S') AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at FROM events"
)
def signatures(spark, sf_dir):
    fields = F.create_map(F.lit("type"), "event_type", F.lit("none"), F.lit(""), F.lit("k"), F.get_json_object("props", "$.k"))
    at = F.date_trunc("second", F.col("ts"))
    return t(spark, sf_dir, "events").select("event_id", fn.signature(fields).alias("signed"), F.sha2("event_type", 256).alias("plain"), fn.default_id(F.col("ts")).alias("id"), fn.iso_time(at).alias("at"))


PADS = ["".join(f"\\x{b ^ mask:02X}" for b in b"secret".ljust(64, b"\0")) for mask in (0x36, 0x5C)]


@query(f"SELECT c_custkey, sha256('{PADS[1]}'::BLOB || unhex(sha256('{PADS[0]}'::BLOB || encode(c_name)))) AS mac, '{{\"sub\":\"' || c_custkey || '\"}}' AS token, c_custkey AS subject FROM customer")
def keyed_digests(spark, sf_dir):
    body = F.concat(F.lit('{"sub":"'), F.col("c_custkey"), F.lit('"}'))
    token = F.concat(F.lit("h."), F.translate(F.base64(body.cast("binary")), "+/", "-_"), F.lit(".s"))
    return t(spark, sf_dir, "customer").select("c_custkey", fn.hmac_sha256(b"secret", F.col("c_name")).alias("mac"), body.alias("token"), fn.jwt_payload(token, "sub string")["sub"].cast("long").alias("subject"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'body → ' || o_orderstatus || ': bad' || chr(10) ELSE '' END || 'late' AS errors FROM orders")
def error_lines(spark, sf_dir):
    one = lambda loc, msg: F.struct(loc.cast("array<string>").alias("loc"), F.lit(msg).alias("msg"))
    late = one(F.array(), "late")
    errors = F.when(F.col("o_orderkey") % 2 == 0, F.array(one(F.array(F.lit("body"), "o_orderstatus"), "bad"), late)).otherwise(F.array(late))
    return t(spark, sf_dir, "orders").select("o_orderkey", fn.joined_errors(errors).alias("errors"))


@query(
    "SELECT page_id AS doc_id, 'system_error' AS rule_id, 'Система' AS section, 'critical' AS severity, false AS is_passed, 'Системная ошибка при проверке: Неподдерживаемый формат файла: ' || CASE page_id % 4 WHEN 0 THEN '.doc' ELSE '.txt' END AS message, 'Обратитесь к администратору системы' AS suggestion FROM pages WHERE page_id % 4 < 2"
)
def unsupported_files(spark, sf_dir):
    kind = F.when(F.col("page_id") % 4 == 0, ".doc").when(F.col("page_id") % 4 == 1, ".txt").when(F.col("page_id") % 4 == 2, ".docx").otherwise(".pdf")
    files = t(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), fn.suffix(F.concat(F.lit("a/File"), F.upper(kind))).alias("kind"))
    return rp.error_results(documents_source.unsupported(documents_source.accepted(files))).select(*COLUMNS)


@query("SELECT n_nationkey, n_name FROM nation WHERE n_name = (SELECT n_name FROM nation WHERE n_nationkey = 7)")
def unique_name_lookup(spark, sf_dir):
    nation = t(spark, sf_dir, "nation")
    row = rel.one(rel.lookup(nation, n_nationkey=7))
    return rel.lookup(nation, n_name=row.n_name).select("n_nationkey", "n_name")


@query("SELECT o_custkey AS user_id, count(*) AS documents_count, round(avg(CAST(floor(o_totalprice) AS BIGINT) % 101), 4) AS average_compliance, round(avg(CASE WHEN o_orderstatus <> 'P' THEN o_orderkey % 60 END), 4) AS average_time_minutes FROM orders GROUP BY 1")
def user_averages(spark, sf_dir):
    orders = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), (F.floor("o_totalprice") % 101).alias("score"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey") % 60).alias("analysis_time"))
    return rel.user_stats(orders).select("user_id", "documents_count", fn.half_up(F.col("average_compliance"), 4).alias("average_compliance"), fn.half_up(F.col("average_time_minutes"), 4).alias("average_time_minutes"))


@query("SELECT l_orderkey, l_linenumber, o_totalprice, o_orderstatus FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l_orderkey AND o.o_custkey = 11)")
def checks_with_documents(spark, sf_dir):
    documents = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_totalprice", "o_orderstatus")
    checks = rel.owned_with_parent(t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), documents, "l_orderkey", 11, "o_custkey", "document")
    return checks.select("l_orderkey", "l_linenumber", "document.o_totalprice", "document.o_orderstatus")


@query(f"WITH {REPORT} SELECT CAST(doc_id AS VARCHAR) AS document_id, CAST(total_checks AS INTEGER) AS total_checks, CAST(critical_issues AS INTEGER) AS critical_issues, CAST(NULL AS VARCHAR) AS filename FROM scored")
def report_files(spark, sf_dir):
    path = new_folder(spark, "reports")
    write_reports(reports(spark, sf_dir).withColumnRenamed("doc_id", "document_id").withColumn("document_id", F.col("document_id").cast("string")), path)
    return read_reports(spark, path).select("document_id", "total_checks", "critical_issues", "filename")


@query(f"WITH {RULE_ROWS} SELECT id, section, title, description, type, severity, check_type, expected_value FROM r")
def rules_from_file(spark, sf_dir):
    """The standard's rules, written as a rule set and loaded from there."""
    groups = {kind: {r.id: asdict(r) for r in STANDARD if r.rule_type == kind} for kind in rules_source.GROUPS}
    path = new_folder(spark, "rules")
    spark.createDataFrame([(json.dumps({"rules": groups}, ensure_ascii=False),)], "value string").coalesce(1).write.text(path)
    return rules_source.exported(rules_source.rules_frame(spark, rules_source.load_rules(spark, path)))


@query(f"WITH {REPORT} SELECT doc_id, score, CASE WHEN is_compliant THEN 'Идеален' ELSE 'Отправлен на доработку' END AS status, 100 AS progress FROM scored")
def arrivals(spark, sf_dir):
    """The documents as a stream of files, checked as they arrive; the sink holds all results once the stream has ended."""
    at = new_folder(spark, "arrivals")
    documents = t(spark, sf_dir, "documents")
    stream = check_arrivals(spark, f"{sf_dir}/documents*.parquet", documents.schema, lambda d: fx.corpus_facts(d, [r.field for r in CORPUS]), CORPUS, f"{at}/results", f"{at}/state")
    stream.awaitTermination()
    return with_progress(arrival_reports(spark.read.parquet(f"{at}/results"))).select("doc_id", "score", "status", "progress")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_by_document(spark, sf_dir)
