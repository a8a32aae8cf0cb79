"""Further queries of the catalogue: transactions, streams with state, rules as tables, dense keys."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from docaudit.functions import text as fn
from docaudit.operators import facts as fx
from docaudit.operators import relational as rel
from docaudit.operators import report as rp
from docaudit.operators import rule_table as rt
from docaudit.operators import stored as st
from docaudit.plans import api
from docaudit.plans.catalogue import FACTS, REPORT, SQL, paragraphs_of, query, t
from docaudit.plans.profiles import CHECKED, COMPLIANT, CORPUS, LOADED, RETURNED, STATUSES, TRANSITIONS, UNDER_WAY, Rule
from docaudit.sources import docx_source
from docaudit.sources.reports import STARTED
from docaudit.sources.versions import VersionedTables
from docaudit.sources.workspace import new_folder
from docaudit.streaming import checks
from docaudit.streaming.machine import run_machine


def facts_of(docs):
    return fx.corpus_facts(docs, [r.field for r in CORPUS])


# Several tables in one transaction

STORED = f"""WITH {REPORT}, m AS (SELECT doc_id, count(*) AS n FROM results WHERE NOT is_passed AND severity IN ('critical', 'warning') GROUP BY doc_id)
SELECT doc_id, CASE WHEN is_compliant THEN 'Идеален' ELSE 'Отправлен на доработку' END AS status, score, coalesce(n, 0) AS mistakes"""


@query(f"{STORED}, '{{\"total_checks\":' || total_checks || ',\"passed_checks\":' || passed_checks || ',\"score\":' || score || ',\"is_compliant\":' || is_compliant || '}}' AS result FROM scored LEFT JOIN m USING (doc_id)")
def published_checks(spark, sf_dir):
    """Checks of all documents started in one version and finished in the next, read from what readers see."""
    store, docs = VersionedTables(spark, new_folder(spark, "published")), t(spark, sf_dir, "documents")
    checks.start(store, docs)
    checks.finish(store, facts_of(docs), CORPUS)
    counted = store.read("mistakes").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    rows = store.read("documents").join(store.read("checks").select("doc_id", "result"), "doc_id").join(counted, "doc_id", "left")
    return rows.select("doc_id", "status", "score", F.coalesce("n", F.lit(0)).alias("mistakes"), "result")


@query(f"{STORED} FROM scored LEFT JOIN m USING (doc_id)")
def checked_once(spark, sf_dir):
    """The documents as a stream into three tables. The stream is run twice, the second time without its notes, as after a lost checkpoint:
    its batches come again under their numbers, and change nothing."""
    at = new_folder(spark, "checked")
    store, schema = VersionedTables(spark, f"{at}/tables"), t(spark, sf_dir, "documents").schema
    for run in ("first", "again"):
        checks.check_stream(spark, f"{sf_dir}/documents*.parquet", schema, facts_of, CORPUS, store, f"{at}/{run}").awaitTermination()
    counted = store.read("mistakes").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return store.read("scores").join(counted, "doc_id", "left").select("doc_id", "status", "score", F.coalesce("n", F.lit(0)).alias("mistakes"))


# The state machine

SIGNALS = {"view": LOADED, "click": UNDER_WAY, "signup": CHECKED, "purchase": COMPLIANT, "error": RETURNED}
TIMEOUT, DELAY = 6 * 3_600_000_000, 3_600_000
_LEGAL = " OR ".join(f"(coalesce(b, '') = '{before}' AND e.signal IN ({', '.join(repr(x) for x in after)}))" for before, after in TRANSITIONS.items())


@query(
    f"""WITH RECURSIVE lim AS (SELECT epoch_ms(max(ts)) - {DELAY} AS passed FROM events),
e AS (SELECT user_id, event_id, epoch_us(ts) AS u, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SIGNALS.items())} END AS signal, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events, lim WHERE epoch_us(ts) // 1000 < passed),
w AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS u, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS signal, CAST(NULL AS VARCHAR) AS before, CAST(NULL AS VARCHAR) AS after, false AS legal, CAST(0 AS BIGINT) AS since, CAST(NULL AS BIGINT) AS timer FROM e
  UNION ALL SELECT user_id, r, u, event_id, signal, b, CASE WHEN legal THEN signal ELSE b END, legal, CASE WHEN legal THEN u ELSE since END, timer FROM (
    SELECT x.*, ({_LEGAL.replace("e.signal", "signal")}) AS legal FROM (
      SELECT e.user_id, e.r, e.u, e.event_id, e.signal, CASE WHEN w.after = '{UNDER_WAY}' AND w.since + {TIMEOUT} <= e.u THEN 'Ошибка' ELSE w.after END AS b,
        CASE WHEN w.after = '{UNDER_WAY}' AND w.since + {TIMEOUT} <= e.u THEN w.since + {TIMEOUT} END AS timer, w.since FROM w JOIN e ON e.user_id = w.user_id AND e.r = w.r + 1) x)),
z AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY r DESC) AS k FROM w)
SELECT user_id, u AS at, event_id, signal, before, after, legal FROM w WHERE r > 0
UNION ALL SELECT user_id, timer, NULL, NULL, '{UNDER_WAY}', 'Ошибка', true FROM w WHERE timer IS NOT NULL
UNION ALL SELECT user_id, since + {TIMEOUT}, NULL, NULL, '{UNDER_WAY}', 'Ошибка', true FROM z, lim WHERE k = 1 AND after = '{UNDER_WAY}' AND (since + {TIMEOUT}) // 1000 < passed"""
)
def status_machine(spark, sf_dir):
    """All events as a stream of signals, one hour of lateness allowed; checks that nothing is heard of for six hours fail."""
    at, schema = new_folder(spark, "machine"), t(spark, sf_dir, "events").schema
    kinds = F.create_map(*[F.lit(x) for kv in SIGNALS.items() for x in kv])
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet").withColumn("signal", kinds[F.col("event_type")])
    run_machine(events, "user_id", "ts", "event_id", "signal", TIMEOUT, f"{DELAY // 1000} seconds", f"{at}/rows", f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/rows").select(F.col("key").alias("user_id"), "at", F.col("tie").alias("event_id"), "signal", "before", "after", "legal")


# Rules as a table

STANDARDS = 250
LANGS = ["en", "de", "fr", "es"]
RULE_PARTS = """rules AS (SELECT p_partkey // 8 AS standard_id, CAST(p_partkey % 8 AS INTEGER) AS n, p_size AS s, lower(p_type) AS kind, ['en', 'de', 'fr', 'es'][1 + p_size % 4] AS lang FROM part)"""
NAMES = ["list_presence", "range", "min_value", "max_value", "contains", "equals", "object_equals", "object_contains"]


def rule_files(spark, sf_dir):
    """A rule set a line, as JSON files: eight parts each make a standard's rules, one for each check."""
    n, s = F.col("p_partkey") % 8, F.col("p_size")
    lang = F.element_at(F.array(*map(F.lit, LANGS)), 1 + s % 4)
    quoted = lambda c: F.to_json(F.array(c))
    expected = [
        F.to_json(F.array(F.lit("the"), F.lower("p_type"), F.lit("and"))), F.format_string('{"min":%d,"max":%d}', s % 5, s), (s * 4).cast("string"), (s * 40).cast("string"),
        F.substring_index(F.regexp_replace(quoted(F.when(s % 2 == 0, "The ").otherwise("Und ")), r"^\[", ""), "]", 1), F.concat(F.lit('"'), lang, F.lit('"')),
        F.format_string('{"lang":"%s","source":"src%d"}', lang, s % 20), F.when(s % 2 == 1, F.format_string('{"lang":"%s","place":1}', lang)).otherwise(F.format_string('{"lang":"%s"}', lang)),
    ]
    fields = ["elements", "line_count", "word_count", "word_count", "full_text", "lang", "origin", "origin"]
    pick = lambda values: F.element_at(F.array(*[v if not isinstance(v, str) else F.lit(v) for v in values]), (n + 1).cast("int"))
    field = F.when((n == 6) & (s % 10 == 0), "page_margins").otherwise(pick(fields))
    rule = F.struct(
        F.concat(F.lit("r"), n).alias("id"), F.concat(F.lit("6."), n).alias("section"), F.concat(F.lit("Rule "), n, F.lit(" - of "), "p_name").alias("title"), F.lit("").alias("content"), F.when(n == 0, "structure").when(n == 4, "content").otherwise("formatting").alias("rule_type"),
        field.alias("field"), F.parse_json(pick(expected)).alias("expected_value"), pick(NAMES).alias("check_type"), F.element_at(F.array(*map(F.lit, ("critical", "warning", "info"))), (1 + n % 3).cast("int")).alias("severity"), F.when(s % 2 == 0, F.col("p_brand")).alias("description"),
    )
    named = t(spark, sf_dir, "part").select(F.expr("p_partkey div 8").alias("standard_id"), n.alias("n"), F.struct(F.concat(F.lit("r"), n).alias("key"), rule.alias("value")).alias("e"))
    group = lambda own: F.map_from_entries(F.collect_list(F.when(own, F.col("e"))))
    sets = named.groupBy("standard_id").agg(F.struct(group(F.col("n") == 0).alias("structure"), group(F.col("n") > 0).alias("formatting")).alias("rules"))
    path = new_folder(spark, "rule-sets")
    sets.select(F.to_json(F.struct("standard_id", "rules")).alias("value")).write.text(path)
    return path


def rules_of(spark, sf_dir):
    """The rules of those files as rows."""
    lines = spark.read.text(rule_files(spark, sf_dir))
    return rt.rule_sets(lines.select(F.get_json_object("value", "$.standard_id").cast("long").alias("standard_id"), F.col("value").alias("text")))


RULE_RESULTS = f"""{FACTS}, {RULE_PARTS}, judged AS (SELECT doc_id, r.standard_id, 'r' || n AS rule_id, n, ['critical', 'warning', 'info'][1 + n % 3] AS severity,
  CASE n WHEN 0 THEN array_to_string(list_filter(['the', kind, 'and'], lambda e: len(list_filter(elements, lambda a: contains(a, e))) = 0), ', ')
    WHEN 1 THEN CASE WHEN line_count < s % 5 THEN ' меньше минимально допустимого ' || s % 5 WHEN line_count > s THEN ' больше максимально допустимого ' || s ELSE '' END
    WHEN 2 THEN CASE WHEN word_count < s * 4 THEN ' меньше минимально допустимого ' || s * 4 ELSE '' END WHEN 3 THEN CASE WHEN word_count > s * 40 THEN ' больше максимально допустимого ' || s * 40 ELSE '' END
    WHEN 4 THEN CASE WHEN contains(lower(full_text), CASE WHEN s % 2 = 0 THEN 'the ' ELSE 'und ' END) THEN '' ELSE 'не ' END WHEN 5 THEN CASE WHEN f.lang = r.lang THEN '' ELSE f.lang END
    WHEN 6 THEN CASE WHEN s % 10 = 0 THEN 'missing' ELSE concat_ws('; ', CASE WHEN f.lang <> r.lang THEN 'lang: ожидалось ' || r.lang || ', получено ' || f.lang END, CASE WHEN source <> 'src' || s % 20 THEN 'source: ожидалось src' || s % 20 || ', получено ' || source END) END
    ELSE concat_ws(', ', CASE WHEN f.lang <> r.lang THEN 'lang (неверное значение)' END, CASE WHEN s % 2 = 1 THEN 'place' END) END AS wrong, s, r.lang AS expected, line_count, word_count
  FROM facts f JOIN rules r ON r.standard_id = f.doc_id % {STANDARDS}),
ruled AS (SELECT doc_id, standard_id, rule_id, severity, wrong = '' AS is_passed, CASE n
  WHEN 0 THEN CASE WHEN wrong = '' THEN 'Все обязательные элементы присутствуют' ELSE 'Отсутствуют элементы: ' || wrong END
  WHEN 1 THEN 'Значение ' || line_count || CASE WHEN wrong = '' THEN ' находится в допустимом диапазоне [' || s % 5 || ', ' || s || ']' ELSE wrong END
  WHEN 2 THEN 'Значение ' || word_count || CASE WHEN wrong = '' THEN ' не меньше минимально допустимого ' || s * 4 ELSE wrong END
  WHEN 3 THEN 'Значение ' || word_count || CASE WHEN wrong = '' THEN ' не больше максимально допустимого ' || s * 40 ELSE wrong END
  WHEN 4 THEN 'Текст ' || wrong || 'содержит требуемое: ''' || CASE WHEN s % 2 = 0 THEN 'The ' ELSE 'Und ' END || ''''
  WHEN 5 THEN CASE WHEN wrong = '' THEN 'Соответствует требованию: ' || expected ELSE 'Не соответствует: ожидалось ' || expected || ', получено ' || wrong END
  WHEN 6 THEN CASE wrong WHEN 'missing' THEN 'В документе отсутствуют настройки полей' WHEN '' THEN 'Все параметры соответствуют требованиям' ELSE 'Несоответствия: ' || wrong END
  ELSE CASE WHEN wrong = '' THEN 'Содержит все требуемые свойства' ELSE 'Отсутствуют или неверны свойства: ' || wrong END END AS message,
  CASE WHEN n = 0 AND wrong <> '' THEN 'Добавьте недостающие элементы: ' || wrong WHEN n = 6 AND wrong = 'missing' THEN 'Добавьте настройки полей страницы в документ' END AS suggestion FROM judged)"""


def judged(spark, sf_dir):
    facts = fx.corpus_facts(t(spark, sf_dir, "documents")).withColumn("standard_id", F.col("doc_id") % STANDARDS)
    return rt.evaluate(facts, rules_of(spark, sf_dir), "standard_id")


@query(f"WITH {RULE_RESULTS} SELECT * FROM ruled")
def rule_table_results(spark, sf_dir):
    return judged(spark, sf_dir).select("doc_id", "standard_id", "rule_id", "severity", "is_passed", "message", "suggestion")


@query(f"WITH {RULE_RESULTS} SELECT doc_id, count(*) AS total_checks, count(*) FILTER (is_passed) AS passed_checks, count(*) FILTER (NOT is_passed AND severity = 'critical') AS critical_issues, CAST(round_even(count(*) FILTER (is_passed) * 100 / count(*), 0) AS INTEGER) AS score FROM ruled GROUP BY doc_id")
def rule_table_report(spark, sf_dir):
    return rp.report(judged(spark, sf_dir)).select("doc_id", "total_checks", "passed_checks", "critical_issues", "score")


@query("SELECT p_partkey // 8 AS standard_id, count(*) AS total_rules, count(*) FILTER (p_partkey % 8 = 0) AS structure, count(*) FILTER (p_partkey % 8 NOT IN (0, 4)) AS formatting, count(*) FILTER (p_partkey % 8 = 4) AS content, count(*) FILTER (p_partkey % 8 % 3 = 0) AS critical, count(*) FILTER (p_partkey % 8 % 3 = 1) AS warning, count(*) FILTER (p_partkey % 8 % 3 = 2) AS info FROM part GROUP BY 1")
def rule_table_summary(spark, sf_dir):
    return rt.summary(rules_of(spark, sf_dir))


@query("SELECT p_partkey // 8 AS standard_id, '6.' || p_partkey % 8 AS section, string_agg('r' || p_partkey % 8 || '/' || ['critical', 'warning', 'info'][1 + p_partkey % 8 % 3], ',') AS rules FROM part GROUP BY 1, 2")
def rule_table_sections(spark, sf_dir):
    grouped = rt.by_section(rules_of(spark, sf_dir))
    return grouped.select("standard_id", "section", F.array_join(F.transform("rules", lambda r: F.concat_ws("/", r["id"], r["severity"])), ",").alias("rules"))


@query(
    f"""WITH {RULE_PARTS.replace("AS lang FROM", "AS lang, p_name, p_brand FROM")} SELECT standard_id, 'r' || n AS id, '6.' || n AS section, 'Rule ' || n || ' - of ' || p_name AS title, CASE WHEN s % 2 = 0 THEN p_brand ELSE '' END AS description,
CASE n WHEN 0 THEN 'structure' WHEN 4 THEN 'content' ELSE 'formatting' END AS type, ['critical', 'warning', 'info'][1 + n % 3] AS severity, {json.dumps(NAMES).replace('"', "'")}[n + 1] AS check_type,
CASE n WHEN 0 THEN '["the","' || kind || '","and"]' WHEN 1 THEN '{{"max":' || s || ',"min":' || s % 5 || '}}' WHEN 2 THEN CAST(s * 4 AS VARCHAR) WHEN 3 THEN CAST(s * 40 AS VARCHAR) WHEN 4 THEN CASE WHEN s % 2 = 0 THEN '"The "' ELSE '"Und "' END
WHEN 5 THEN '"' || lang || '"' WHEN 6 THEN '{{"lang":"' || lang || '","source":"src' || s % 20 || '"}}' ELSE '{{"lang":"' || lang || '"' || CASE WHEN s % 2 = 1 THEN ',"place":1' ELSE '' END || '}}' END AS expected_value FROM rules"""
)
def rule_table_export(spark, sf_dir):
    return rt.exported(rules_of(spark, sf_dir))


# Dense keys, guarded appends


@query(
    """WITH old AS (SELECT o_orderkey AS document_id, 1 AS kind FROM orders), new AS (SELECT DISTINCT l_orderkey AS document_id, l_linenumber AS kind, l_returnflag = 'A' AS started FROM lineitem)
SELECT document_id, kind, NULL AS result FROM old UNION ALL SELECT l_orderkey, l_linenumber, '{"status":"analyzing"}' FROM lineitem WHERE l_returnflag = 'A'
UNION ALL SELECT document_id, kind, 'done' FROM new WHERE NOT started AND NOT (kind = 1 AND document_id IN (SELECT document_id FROM old))"""
)
def unique_append_bypass(spark, sf_dir):
    """Checks under way are let in unchecked; of the others only those whose key is free, once each."""
    old = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("result"))
    result = F.when(F.col("l_returnflag") == "A", STARTED).otherwise("done")
    new = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("kind"), result.alias("result"))
    return rel.append_unique(old, new, ["document_id", "kind"], bypass=F.col("result") == STARTED)



@query(
    """WITH have AS (SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 3 <> 0), wanted AS (SELECT DISTINCT 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS name FROM orders),
new AS (SELECT name FROM wanted WHERE name NOT IN (SELECT name FROM have)) SELECT name, id FROM have UNION ALL SELECT name, (SELECT max(id) FROM have) + row_number() OVER (ORDER BY name) FROM new"""
)
def dense_keys(spark, sf_dir):
    """Names of customers that orders have, with new keys for those the table of names lacks."""
    have = t(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("id"))
    wanted = t(spark, sf_dir, "orders").select(F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("name"))
    return rel.get_or_create(have, wanted, "name", "id")


# From uploaded bytes to a status


def docx_files(docs):
    """(key, name, content): a DOCX file of the paragraphs of each document."""
    rows, sections = paragraphs_of(docs)
    fields = ["para_num", "text", "style_name", "runs", "line_spacing", "first_line_indent_cm"]
    own = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("paragraphs"))
    ends = sections.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*[c for c in sections.columns if c != "doc_id"]))).alias("sections"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, docx_source.FILES_PER_BATCH) for b in batches for i in range(0, b.num_rows, docx_source.FILES_PER_BATCH)):
            rows = batch.to_pylist()
            content = [docx_source.docx_bytes(r["paragraphs"] or [], r["sections"]) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([f"Document {r['doc_id']}.docx" for r in rows], pa.string()), pa.array(content, pa.binary())], names=["key", "name", "content"])

    return ends.join(own, "doc_id", "left").mapInArrow(made, "key long, name string, content binary")


def uploaded(spark, files, name):
    """Files landed by the sink; their folder."""
    docx_source.register(spark)
    path = new_folder(spark, name)
    files.write.format("uploads").mode("append").save(path)
    return path


def docx_facts(spark, sf_dir):
    """Facts of the documents' paragraphs as read from uploaded DOCX files."""
    path = uploaded(spark, docx_files(t(spark, sf_dir, "documents")), "uploads")
    at = new_folder(spark, "parsed")  # the facts read paragraphs several times; the files are opened and parsed once
    spark.read.format("docx_parts").options(part="documents", index="true").load(path).withColumn("doc_id", F.regexp_extract("doc_id", r"(\d+)\.docx$", 1).cast("long")).write.parquet(at)
    part = lambda name: spark.read.parquet(at).select("doc_id", F.inline(name))
    return fx.paragraph_facts(part("paragraphs"), part("sections"))


@query(SQL["paragraph_facts"])
def docx_flow(spark, sf_dir):
    return docx_facts(spark, sf_dir).select(
        "doc_id", F.array_join("required_elements", "|").alias("elements"), "font_settings.*", F.col("paragraph_indent").alias("indent"), F.col("page_margins.left").alias("left_margin"), F.col("page_margins.top").alias("top_margin"),
        "page_count", "full_text", F.col("introduction_text").alias("introduction"), "word_count",
    )


THESIS = [
    Rule("t1", "1", "Elements", "structure", "required_elements", ["введение", "титульный лист", "основная часть"], "list_presence", "critical"),
    Rule("t2", "2", "Font", "formatting", "font_settings", {"font_family": "Times New Roman", "font_size": 14}, "object_equals", "warning"),
    Rule("t3", "3", "Words", "formatting", "word_count", 60, "min_value", "warning"),
]


@query(
    f"""WITH pf AS ({SQL["paragraph_facts"]}), c AS (SELECT doc_id, CAST(contains(elements, 'введение') AND contains(elements, 'титульный лист') AND contains(elements, 'основная часть') AS INTEGER)
+ CAST(coalesce(font_family = 'Times New Roman' AND font_size = 14, false) AS INTEGER) + CAST(word_count >= 60 AS INTEGER) AS passed FROM pf)
SELECT doc_id, CAST(round_even(passed * 100 / 3, 0) AS INTEGER) AS score, CASE WHEN passed = 3 THEN 'Идеален' ELSE 'Отправлен на доработку' END AS status FROM c"""
)
def upload_to_status(spark, sf_dir):
    """Bytes of DOCX files, uploaded, read, checked and rated."""
    return rp.status(rp.reports(docx_facts(spark, sf_dir), THESIS)).select("doc_id", "score", "status")


KINDS = [".pdf", ".DOC", ".docx", ".txt", ".exe", ""]


@query(
    f"""SELECT page_id AS key, name, octet_length(encode(html)) AS size, CASE WHEN page_id % 6 > 3 THEN '{docx_source.REFUSED}' END AS error, CASE WHEN page_id % 6 <= 3 THEN sha256(html) END AS digest, CASE WHEN page_id % 6 <= 3 THEN name END AS saved
FROM (SELECT page_id, coalesce(html, '') AS html, 'page' || page_id || {json.dumps(KINDS).replace('"', "'")}[1 + page_id % 6] AS name FROM pages)"""
)
def landed_files(spark, sf_dir):
    """Pages as uploaded files, by the index, with the digest of each file's bytes."""
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (1 + F.col("page_id") % 6).cast("int"))
    path = uploaded(spark, t(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), F.concat(F.lit("page"), "page_id", kind).alias("name"), F.coalesce("html", F.lit("")).cast("binary").alias("content")), "landed")
    files = spark.read.format("binaryFile").load(f"{path}/files/*").select(F.regexp_extract("path", "[^/]+$", 0).alias("saved_name"), F.sha2("content", 256).alias("digest"))
    rows = docx_source.upload_index(spark, path).join(files, "saved_name", "left")
    return rows.select("key", "name", "size", "error", "digest", F.regexp_replace("saved_name", "^[0-9]+_[0-9a-f]{8}_", "").alias("saved"))


# The API's queries as SQL table functions

#: The service's tables as SQL over the given ones.
API_TABLES = {
    "users": "SELECT c_custkey AS user_id, c_name AS first_name, c_mktsegment AS role, c_custkey % 50 = 0 AS is_admin FROM customer",
    "documents": "SELECT o_orderkey AS document_id, o_custkey AS user_id, o_orderpriority AS filename, CASE o_orderstatus WHEN 'F' THEN 5 WHEN 'O' THEN 2 WHEN 'P' THEN 9 END AS status_id, o_orderkey % 101 AS score FROM orders",
    "check": "SELECT l_orderkey * 100 + l_linenumber AS check_id, l_orderkey AS document_id, l_suppkey % 7 AS standart_id, l_linestatus AS result, l_partkey % 101 AS score FROM lineitem",
    "mistakes": "SELECT l_orderkey * 1000 + l_linenumber AS mistake_id, CASE l_returnflag WHEN 'A' THEN 1 ELSE 2 END AS mistake_type_id, l_returnflag AS description, l_orderkey AS document_id FROM lineitem WHERE l_returnflag <> 'N'",
    "reports": "SELECT l_orderkey * 100 + l_linenumber AS report_id, l_orderkey * 100 + l_linenumber AS check_id, l_returnflag AS report_json FROM lineitem WHERE l_linenumber = 1",
    "reviews": "SELECT event_id AS review_id, user_id, 1 + event_id % 5 AS rating, event_type AS review_text FROM events",
    "standart": "SELECT n_nationkey AS standart_id, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN '1.0' END AS version FROM nation",
    "statuses": "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{name}')" for i, name in enumerate(STATUSES, 1)) + ") AS s(status_id, status_name)",
    "mistake_types": "SELECT r_regionkey AS mistake_type_id, r_name AS mistake_type_name FROM region",
}
_SEEN = "(SELECT 1 FROM a_documents d WHERE d.document_id = x.document_id AND d.user_id = {})"
#: Endpoint, arguments, the column that is added up, and the rows in SQL.
API_CALLS = [
    ("all_documents", (1, True), "document_id", "SELECT document_id AS k FROM a_documents"), ("all_documents", (1, False), "document_id", "SELECT document_id AS k FROM a_documents WHERE false"),
    ("document_by_id", (40, 0, True), "document_id", "SELECT document_id AS k FROM a_documents WHERE document_id = 40"), ("document_by_id", (40, -1, False), "document_id", "SELECT 1 AS k WHERE false"),
    ("documents_by_user", (5, 5, False), "document_id", "SELECT document_id AS k FROM a_documents WHERE user_id = 5"), ("documents_by_user", (5, 6, False), "document_id", "SELECT 1 AS k WHERE false"),
    ("documents_by_status", (2,), "document_id", "SELECT document_id AS k FROM a_documents WHERE status_id = 2"), ("document_full_info", (40, 0, True), "mistakes", "SELECT count(*) AS k FROM a_mistakes WHERE document_id = 40"),
    ("gost_result", (4001, 0, True), "score", "SELECT d.score AS k FROM a_check c JOIN a_documents d USING (document_id) WHERE check_id = 4001"), ("all_checks", (), "check_id", "SELECT check_id AS k FROM a_check"),
    ("check_by_id", (4001,), "check_id", "SELECT check_id AS k FROM a_check WHERE check_id = 4001"), ("checks_by_document", (40,), "check_id", "SELECT check_id AS k FROM a_check WHERE document_id = 40"), ("checks_by_standard", (3,), "check_id", "SELECT check_id AS k FROM a_check WHERE standart_id = 3"),
    ("all_mistakes", (), "mistake_id", "SELECT mistake_id AS k FROM a_mistakes"), ("mistake_by_id", (40001,), "mistake_id", "SELECT mistake_id AS k FROM a_mistakes WHERE mistake_id = 40001"), ("mistakes_by_document", (40, 5, True), "mistake_id", "SELECT mistake_id AS k FROM a_mistakes WHERE document_id = 40"),
    ("mistakes_by_document", (40, 5, False), "mistake_id", f"SELECT mistake_id AS k FROM a_mistakes x WHERE document_id = 40 AND EXISTS {_SEEN.format(5)}"), ("mistakes_by_type", (1,), "mistake_id", "SELECT mistake_id AS k FROM a_mistakes WHERE mistake_type_id = 1"),
    ("all_mistake_types", (), "mistake_type_id", "SELECT mistake_type_id AS k FROM a_mistake_types"), ("mistake_type_by_id", (3,), "mistake_type_id", "SELECT mistake_type_id AS k FROM a_mistake_types WHERE mistake_type_id = 3"), ("all_reports", (), "report_id", "SELECT report_id AS k FROM a_reports"),
    ("report_by_id", (4001,), "report_id", "SELECT report_id AS k FROM a_reports WHERE report_id = 4001"), ("reports_by_check", (4001,), "report_id", "SELECT report_id AS k FROM a_reports WHERE check_id = 4001"),
    ("reports_by_user", (5, 5, False), "report_id", "SELECT report_id AS k FROM a_reports JOIN a_check USING (check_id) JOIN a_documents USING (document_id) WHERE user_id = 5"), ("all_reviews", (), "review_id", "SELECT review_id AS k FROM a_reviews"),
    ("review_by_id", (7,), "review_id", "SELECT review_id AS k FROM a_reviews WHERE review_id = 7"), ("reviews_by_user", (8,), "review_id", "SELECT review_id AS k FROM a_reviews WHERE user_id = 8"), ("all_standards", (), "standart_id", "SELECT standart_id AS k FROM a_standart"),
    ("standard_by_id", (3,), "standart_id", "SELECT standart_id AS k FROM a_standart WHERE standart_id = 3"), ("all_statuses", (), "status_id", "SELECT status_id AS k FROM a_statuses"), ("status_by_id", (2,), "status_id", "SELECT status_id AS k FROM a_statuses WHERE status_id = 2"),
    ("all_users", (0, True), "user_id", "SELECT user_id AS k FROM a_users"), ("user_by_id", (9, 9, False), "user_id", "SELECT user_id AS k FROM a_users WHERE user_id = 9"), ("user_by_id", (9, 8, False), "user_id", "SELECT 1 AS k WHERE false"),
]


def api_tables(spark, sf_dir):
    given = {name: t(spark, sf_dir, name) for name in ("customer", "orders", "lineitem", "events", "nation", "region")}
    return {name: spark.sql(body.replace(f"FROM {source}", "FROM {rows}"), rows=given[source]) if (source := next((g for g in given if f"FROM {g}" in body), None)) else spark.sql(body) for name, body in API_TABLES.items()}


@query(
    "WITH " + ", ".join(f"a_{name} AS ({body})" for name, body in API_TABLES.items()) + " " + " UNION ALL ".join(f"SELECT '{name} {i}' AS endpoint, count(*) AS n, CAST(coalesce(sum(k), 0) AS BIGINT) AS keys FROM ({body})" for i, (name, _, _, body) in enumerate(API_CALLS))
)
def api_reads(spark, sf_dir):
    """A call of every read endpoint, with and without the right to see the rows: number of rows and sum of their keys."""
    api.install(spark, api_tables(spark, sf_dir))
    out = None
    for i, (name, args, column, _) in enumerate(API_CALLS):
        rows = api.call(spark, name, *args).agg(F.lit(f"{name} {i}").alias("endpoint"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col(column).cast("long")), F.lit(0)).alias("keys"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "WITH " + ", ".join(f"a_{name} AS ({API_TABLES[name]})" for name in ("documents", "statuses")) + """ SELECT document_id, user_id, coalesce(status_name, 'Неизвестно') AS status, CAST(CASE status_name WHEN 'Анализируется' THEN 50 WHEN 'Проверен' THEN 80 WHEN 'Идеален' THEN 100 WHEN 'Отправлен на доработку' THEN 100 ELSE 0 END AS INTEGER) AS progress
FROM a_documents LEFT JOIN a_statuses USING (status_id)"""
)
def api_status_of_all(spark, sf_dir):
    """The status endpoint asked for every document by its owner: a lateral call, which is a join."""
    api.install(spark, api_tables(spark, sf_dir))
    return spark.sql("SELECT d.document_id, d.user_id, s.status, s.progress FROM api_documents d, LATERAL api_gost_status(d.document_id, d.user_id) s")


# Stored results of any shape

#: Results by the event's number: as they should be, drifted fields, broken, none, other shapes.
SHAPES = [
    ('{{"score": {k}, "is_compliant": true, "report": {{"total_checks": {k}, "passed_checks": "3", "results": [{{"severity": "critical", "message": "m{k}"}}, {{"severity": "warning"}}]}}}}', ("{k}", "true", "{k}", "3", "'m' || k", "'Неизвестное замечание'")),
    ('{{"score": [{k}], "report": {{"total_checks": [1, 2], "passed_checks": 2.5, "results": {{"severity": "critical", "message": ["one", {k}]}}}}}}', ("0", "false", "0", "2.5", "'[\"one\",' || k || ']'", "''")),
    ('{{"score": {k}', ("0", "false", "0", "0", "'Ошибка чтения отчёта из БД'", "''")),
    (None, ("0", "false", "0", "0", "''", "''")),
    ('{{"score": "{k}", "report": null, "is_compliant": {{}}, "total_checks": 7, "results": [{k}, null, {{"severity": "warning", "message": 5}}]}}', ("{k}", "false", "7", "0", "''", "'5'")),
    ('[1, {k}]', ("0", "false", "0", "0", "''", "''")),
    ('{{"k": {k}}}', ("0", "false", "0", "0", "''", "''")),
    ('{{"score": {k}.75, "report": {{"total_checks": "many", "passed_checks": null, "results": "none"}}}}', ("{k}.75", "false", "0", "0", "''", "''")),
]


def _shape_sql(i: int) -> str:
    return "CASE event_id % 8 " + " ".join(f"WHEN {n} THEN {values[i].replace('{k}.75', 'k + 0.75').replace('{k}', 'k')}" for n, (_, values) in enumerate(SHAPES)) + " END"


@query(
    f"""SELECT event_id AS check_id, coalesce(c_name, 'unknown') AS filename, event_id % 8 <> 2 AS readable, CAST(coalesce(c_nationkey, {_shape_sql(0)}) AS DOUBLE) AS score, {_shape_sql(1)} AS is_compliant, CAST({_shape_sql(2)} AS DOUBLE) AS total_checks, CAST({_shape_sql(3)} AS DOUBLE) AS passed_checks,
{_shape_sql(4)} AS errors, {_shape_sql(5)} AS warnings FROM (SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events) LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) ON c_custkey = user_id"""
)
def stored_any_shape(spark, sf_dir):
    """Results of eight shapes, made of the events' properties, read by one query."""
    k = F.get_json_object("props", "$.k")
    shapes = [F.lit(None).cast("string") if s is None else F.format_string(s.replace("{{", "{").replace("}}", "}").replace("{k}", "%1$s"), k) for s, _ in SHAPES]
    checks_ = t(spark, sf_dir, "events").select(F.col("event_id").alias("check_id"), F.col("user_id").alias("document_id"), F.element_at(F.array(*shapes), (1 + F.col("event_id") % 8).cast("int")).alias("result"))
    documents = t(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("document_id"), F.col("c_name").alias("filename"), F.col("c_nationkey").alias("score"))
    return st.stored_results(checks_, documents).withColumns({c: F.array_join(c, "|") for c in ("errors", "warnings")}).drop("document_id")


# Numbers as the reference rounds and prints them


@query(
    "WITH v AS (SELECT l_orderkey, l_partkey, ([l_extendedprice * l_discount / 7, (l_partkey % 1000) / 8.0::DOUBLE, l_tax * 0.00001::DOUBLE, (l_quantity + 0.675::DOUBLE) * -1, l_extendedprice * 1e12::DOUBLE])[1 + l_linenumber % 5] AS x FROM lineitem) SELECT l_orderkey, l_partkey, x, "
    + ", ".join(f"CAST(format('{{:.{p}f}}', x) AS DOUBLE) + 0 AS r{p}" for p in range(3)) + ", CAST(x AS VARCHAR) AS shown FROM v"
)
def exact_numbers(spark, sf_dir):
    """Doubles of several sizes, ties among them, rounded by their binary value and printed in the fewest digits."""
    c = F.col
    values = F.array(c("l_extendedprice") * c("l_discount") / 7, (c("l_partkey") % 1000) / F.lit(8.0), c("l_tax") * F.lit(0.00001), (c("l_quantity") + F.lit(0.675)) * -1, c("l_extendedprice") * F.lit(1e12))
    rows = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.element_at(values, 1 + c("l_linenumber") % 5).alias("x"))
    return rows.select("l_orderkey", "l_partkey", "x", *[(fn.half_even(c("x"), p) + 0.0).alias(f"r{p}") for p in range(3)], fn.number_text(c("x")).alias("shown"))
