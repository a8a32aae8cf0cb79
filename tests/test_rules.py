"""Rules, reports and facts against goldens and hand-derived cases."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docaudit.functions import text as fn
from docaudit.operators import facts as fx
from docaudit.operators import report as rp
from docaudit.plans.profiles import STANDARD, Rule
from docaudit.schemas import FACTS, expectations
from docaudit.sources import rules as rules_source
from docaudit.streaming.status import arrival_reports, check_arrivals

INTRO = "В данной работе рассматривается проблема автоматизации проверки документов. Цель работы - разработать систему проверки соответствия ГОСТам."
GOLDEN = ("g1", ["Титульный лист", "Содержание", "Введение", "Основная часть", "Заключение", "Список литературы"], ("Arial", 12, 1.5), (25.0, 15.0, 20.0, 20.0), 1.25, INTRO, "", 1, 1)


def test_golden_report(spark):
    facts = spark.createDataFrame([GOLDEN], FACTS)
    rows = {r.rule_id: r for r in rp.evaluate(facts, STANDARD).collect()}
    assert [r.rule_id for r in sorted(rows.values(), key=lambda r: r.rule_no)] == ["5.1_required_elements", "6.1.1_font", "6.1.1_margins", "6.1.2_paragraph", "5.6_introduction"]
    assert rows["5.1_required_elements"].message == "Отсутствуют элементы: определения, обозначения и сокращения, список использованных источников, приложения"
    assert rows["5.1_required_elements"].suggestion == "Добавьте недостающие элементы: определения, обозначения и сокращения, список использованных источников, приложения"
    assert rows["6.1.1_font"].message == "Несоответствия: font_family: ожидалось Times New Roman, получено Arial; font_size: ожидалось 14, получено 12"
    assert rows["6.1.1_margins"].is_passed and rows["6.1.1_margins"].message == "Все параметры соответствуют требованиям"
    assert rows["6.1.2_paragraph"].message == "Соответствует требованию: 1.25"
    assert rows["5.6_introduction"].message == "В введении отсутствуют: состояние разработок по теме, обоснование актуальности, обоснование новизны, связь с другими работами, задачи работы"
    report = rp.report(rp.evaluate(facts, STANDARD)).first()
    assert (report.total_checks, report.passed_checks, report.critical_issues, report.warning_issues, report.score, report.success_rate) == (5, 2, 2, 1, 40, 40.0)
    assert not report.is_compliant


def test_null_field_and_absent_facet_differ(spark):
    facts = spark.createDataFrame([("a", (None, 14, 1.5), None)], "doc_id string, font_settings struct<font_family:string,font_size:int,line_spacing:double>, page_margins struct<left:double,right:double,top:double,bottom:double>")
    rows = {r.rule_id: r.message for r in rp.evaluate(facts, [r for r in STANDARD if r.rule_type == "formatting"]).collect()}
    assert rows["6.1.1_font"] == "Несоответствия: font_family: ожидалось Times New Roman, получено None"
    assert rows["6.1.1_margins"] == "В документе отсутствуют настройки полей"
    assert rows["6.1.2_paragraph"] == "В документе отсутствует настройка абзацного отступа"


def test_scores_round_half_to_even_and_nothing_is_not_compliant(spark):
    rows = spark.createDataFrame([(1, 8), (3, 8), (0, 0), (4, 4)], "passed_checks int, total_checks int").withColumn("critical_issues", F.lit(0))
    assert [(r.score, r.is_compliant) for r in rp.with_scores(rows).collect()] == [(12, False), (38, False), (0, False), (100, True)]


def test_truncation_and_synonyms(spark):
    rule = Rule("c", "1", "t", "content", "x", "zz", "contains", "info")
    facts = spark.createDataFrame([("a" * 101,), ("b" * 100,)], "x string").withColumn("doc_id", F.lit(1))
    assert sorted(len(r.actual_json) for r in rp.evaluate(facts, [rule]).collect()) == [100, 103]
    intro = spark.createDataFrame([("Обзор литературы; АКТУАЛЬНОСТЬ ТЕМЫ; новизна работы; взаимосвязь с работами; цель исследования; задачи данной работы", 1)], "introduction_text string, doc_id int")
    assert rp.evaluate(intro, [STANDARD[1]]).first().is_passed


def test_mode_takes_the_first_seen(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate("ABBA")] + [(1, 9, None), (1, 10, None), (1, 11, None)], "k int, pos int, v string")
    assert fx.mode_first_seen(rows, ["k"], "v", "pos", "m").first().m == "A"


def test_anchor_moves_only_with_a_new_line(spark):
    df = spark.sql("SELECT array(10.0D, 9.9D, 8.0D, 7.9D) AS ys").select(fx.anchored_groups(F.col("ys"), lambda a, b: F.abs(a - b), F.lit(1.0)).alias("g"))
    assert df.first().g == [10.0, 8.0]


def test_capture_joins_stretches(spark):
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(["a", "on", "b", "off", "c", "on", "d"])], "k int, pos int, x string")
    assert [r.x for r in fx.capture(rows, ["k"], "pos", F.col("x") == "on", F.col("x") == "off").orderBy("pos").collect()] == ["on", "b", "on", "d"]


def paragraph(i, text, style="Normal", bold=None, font="Arial", size=14.0, line=1.5, indent=1.25):
    return ("d", i, text, style, [(bold, font, size)], line, indent)


def test_paragraph_facts(spark):
    rows = [paragraph(0, "Курсовая работа"), paragraph(1, "Введение", "Heading 1"), paragraph(2, "Цель работы ясна."), paragraph(3, "1. Глава первая", font="Times"), paragraph(4, "Текст 1.1"), paragraph(49, "Студент"), paragraph(50, "ЗАКЛЮЧЕНИЕ"), paragraph(51, "  ")]
    sections = [("d", 0, 25.04, 15.0, 20.0, 0.0), ("d", 1, 1.0, 1.0, 1.0, 1.0)]
    got = fx.paragraph_facts(spark.createDataFrame(rows, fx.PARAGRAPHS), spark.createDataFrame(sections, fx.SECTIONS)).first()
    assert got.required_elements == ["титульный лист", "введение", "глава первая", "заключение", "основная часть"]
    assert got.introduction_text == "Введение Цель работы ясна."
    assert tuple(got.font_settings) == ("Arial", 14, 1.5)
    assert tuple(got.page_margins) == (25.0, 15.0, 20.0, None) and got.page_count == 2 and got.paragraph_indent == 1.25
    assert got.word_count == 13


def test_page_facts(spark):
    text = "Курсовая работа\nВведение\nобычная строка\n1. Глава один"
    pages = spark.createDataFrame([("d", 1, text, 595.0, 842.0)], fx.PAGES)
    glyphs = [("d", 1, 0, "о", "ABCDEF+Arial-Bold", 12.0, 70.9, 80.0, 700.0, 712.0), ("d", 1, 1, "б", "Arial", 12.0, 80.0, 500.0, 700.0, 712.0), ("d", 1, 2, "ы", "Times", 12.0, 106.3, 120.0, 682.0, 694.0), ("d", 1, 3, " ", None, None, 0.0, 1.0, 682.0, 694.0)]
    got = fx.page_facts(pages, spark.createDataFrame(glyphs, fx.CHARS)).first()
    assert "введение" in got.required_elements and "глава один" in got.required_elements and got.required_elements[-1] == "основная часть" and "титульный лист" in got.required_elements
    assert got.font_settings.font_family == "Arial" and got.font_settings.font_size == 12
    assert got.page_margins.left == 25.0
    assert got.introduction_text == "обычная строка"


def test_rules_load_from_json(spark, tmp_path):
    group = {r.id: {k: getattr(r, k) for k in Rule.__dataclass_fields__} for r in STANDARD}
    body = {"rules": {"structure": {k: v for k, v in group.items() if v["rule_type"] == "structure"}, "formatting": {k: v for k, v in group.items() if v["rule_type"] == "formatting"}, "other": {"x": {}}}}
    path = tmp_path / "rules.json"
    path.write_text(json.dumps(body, ensure_ascii=False))
    assert rules_source.load_rules(spark, str(path)) == STANDARD
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        rules_source.load_rules(spark, str(tmp_path / "none.json"))


def test_text_functions(spark):
    row = spark.sql("SELECT '  привет мир_1 abc ' AS t, '17_ab12_x.DOCX' AS f, 'ABCDEF+Arial-Bold' AS font, 1.0D AS d, cast(null AS int) AS n").select(
        fn.word_count(F.col("t")).alias("w"), fn.token_count(F.col("t")).alias("k"), fn.suffix(F.col("f")).alias("s"), fn.display_name(F.col("f"), "-").alias("name"), fn.clean_font_name(F.col("font")).alias("font"),
        fn.shown(F.col("d"), T.DoubleType()).alias("d"), fn.unique_name(F.col("f")).alias("u"),
    ).first()
    assert (row.w, row.k, row.s, row.name, row.font, row.d) == (3, 3, ".docx", "x.DOCX", "Arial", "1.0")
    assert row.u.endswith("_17_ab12_x.DOCX")


def test_expectations_name_what_is_broken(spark):
    from docaudit.operators.relational import violations

    rows = spark.createDataFrame([(1, 6), (2, 5), (3, None)], "review_id int, rating int")
    assert [(r.review_id, r.violations) for r in violations(rows, expectations("reviews")).orderBy("review_id").collect()] == [(1, ["rating"]), (3, ["rating"])]


def test_stream_equals_batch(spark, tmp_path):
    rule = Rule("m", "1", "t", "content", "n", 2, "min_value", "critical")
    docs = spark.createDataFrame([(i, i) for i in range(5)], "doc_id int, n int")
    docs.write.parquet(str(tmp_path / "in"))
    stream = check_arrivals(spark, str(tmp_path / "in"), "doc_id int, n int", lambda d: d, [rule], str(tmp_path / "out"), str(tmp_path / "state"))
    stream.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rp.evaluate(docs, [rule]).collect()))
    assert {r.doc_id: r.status for r in arrival_reports(got).collect()}[4] == "Идеален"
