"""Rules as a table against rules compiled one by one; dense keys; both on odd rows."""

import json

import pytest
from pyspark.sql import functions as F

from docaudit.operators import facts as fx
from docaudit.operators import relational as rel
from docaudit.operators import report as rp
from docaudit.operators import rule_table as rt
from docaudit.operators.numbering import numbered
from docaudit.plans.profiles import CORPUS, STANDARD, Rule

FACTS = "doc_id long, standard_id long, required_elements array<string>, font_settings struct<font_family:string,font_size:int,line_spacing:double>, paragraph_indent double, introduction_text string, full_text string, word_count int, flag boolean"
ODD = [
    (1, 1, ["Титульный лист", "Введение"], ("Times New Roman", 14, 1.5), 1.25, "Цель исследования и обзор литературы", "The text", 10, True), (2, 1, [], ("Arial", None, 2.0), 1.0, "", "", 0, False), (3, 1, None, None, None, None, None, None, None),
    (4, 2, ["x"], ("Arial", 1, 1.0), 5.0, "x", "the", 7, True), (5, None, ["x"], ("Arial", 1, 1.0), 5.0, "x", "the", 7, True), (6, 99, ["x"], ("Arial", 1, 1.0), 5.0, "x", "the", 7, True), (1, 1, ["x"], ("Arial", 1, 1.0), 5.0, "x", "the", 7, True),
]
RULES = [
    *[r for r in STANDARD if r.field != "page_margins"], Rule("r", "1", "A - b", "formatting", "word_count", {"min": 5, "max": 8}, "range", "warning"), Rule("lo", "1", "A", "formatting", "paragraph_indent", 1.25, "min_value", "info"),
    Rule("hi", "1", "A", "formatting", "word_count", 8, "max_value", "info"), Rule("c", "1", "A", "content", "full_text", "The ", "contains", "info"), Rule("e", "1", "A", "content", "flag", True, "equals", "info"), Rule("t", "1", "A", "content", "full_text", "the", "equals", "info"),
    Rule("n", "1", "A", "content", "full_text", 7, "equals", "info"), Rule("o", "1", "A", "formatting", "font_settings", {"font_family": "Arial", "font_size": 1, "place": 2}, "object_contains", "critical"), Rule("m", "1", "A", "formatting", "nowhere", 1, "equals", "critical"),
    Rule("p", "1", "A", "formatting", "page_margins", {"left": 1}, "object_equals", "critical"),
]


def rule_set(rules, standard=1):
    groups = {g: {r.id: {"id": r.id, "section": r.section, "title": r.title, "content": r.content, "rule_type": r.rule_type, "field": r.field, "expected_value": r.expected_value, "check_type": r.check_type, "severity": r.severity} for r in rules if (r.rule_type == "structure") == (g == "structure")} for g in rt.GROUPS}
    return standard, json.dumps({"rules": groups}, ensure_ascii=False)


def table(spark, *texts):
    return rt.rule_sets(spark.createDataFrame(list(texts), "standard_id long, text string"))


def test_a_table_judges_like_compiled_rules(spark):
    facts = spark.createDataFrame(ODD, FACTS)
    same = ["doc_id", "rule_id", "section", "rule_section", "severity", "is_passed", "message", "suggestion"]
    got = rt.evaluate(facts, table(spark, rule_set(RULES)), "standard_id").select(*same).collect()
    # a list or object that is null is a missing fact here; compiled list checks take it for an empty list
    expected = rp.evaluate(facts.filter("standard_id = 1").drop("standard_id"), RULES).select(*same).collect()
    assert len(got) == 4 * len(RULES) and sorted(map(str, got)) == sorted(map(str, expected))


def test_rules_of_documents_without_a_standard(spark):
    got = rt.evaluate(spark.createDataFrame(ODD, FACTS), table(spark, rule_set(RULES[:2], 2), rule_set(RULES[:3], 3)), "standard_id").collect()
    assert [(r.doc_id, r.standard_id) for r in got] == [(4, 2)] * 2
    assert rt.evaluate(spark.createDataFrame([], FACTS), table(spark, rule_set(RULES)), "standard_id").count() == 0


def test_rule_sets_of_any_shape(spark):
    again = json.dumps({"rules": {"structure": {"a": {"id": "x", "title": "first", "expected_value": [1, {"b": None}]}}, "formatting": {"b": {"id": "x", "title": "last", "expected_value": {"z": 1}}, "c": {"title": "no id"}, "d": 7}, "other": {"e": {"id": "y"}}}})
    got = table(spark, (1, again), (2, "{broken"), (3, None), (4, "[]"), (5, '{"rules": 3}'), (None, again)).select("standard_id", "id", "title", F.to_json("expected").alias("e"), "rule_no").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "x", "last", '{"z":1}', 0), (None, "x", "last", '{"z":1}', 0)], key=str)
    assert table(spark).count() == 0


def test_a_check_of_unknown_type_fails(spark):
    got = rt.evaluate(spark.createDataFrame(ODD[:1], FACTS), table(spark, rule_set([Rule("u", "1", "A", "content", "full_text", 1, "riddle", "info")])), "standard_id").first()
    assert (got.is_passed, got.message) == (False, "Неизвестный тип проверки: riddle")


def test_the_plan_does_not_grow_with_rules(spark):
    facts = fx.corpus_facts(spark.createDataFrame([(1, "a", "en", "s")], "doc_id long, text string, lang string, source string")).withColumn("standard_id", F.lit(1))
    size = lambda n: len(rt.evaluate(facts, table(spark, *[rule_set(CORPUS, i) for i in range(n)]), "standard_id")._jdf.queryExecution().executedPlan().toString())
    assert abs(size(1) - size(400)) < 200


# Dense keys


@pytest.mark.parametrize("per_part", [3, 1000])
def test_numbers_are_dense_and_in_order(spark, per_part):
    names = [f"n{i:03}" for i in range(50)] + [None, "", "é"]
    out = numbered(spark.createDataFrame([(n, 1, 2, 3) for n in names], "name string, place int, part int, begin int").repartition(5), ["name"], "id", after=10, rows_per_part=per_part)
    assert out.columns == ["name", "place", "part", "begin", "id"]
    assert [(r.id, r.name) for r in out.orderBy("id").collect()] == list(enumerate(sorted(names, key=lambda x: (x is not None, x)), 11))
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()


def test_equal_rows_share_numbers_out(spark):
    out = numbered(spark.createDataFrame([("a",)] * 20 + [("b",)] * 3, "name string"), ["name"], "id", rows_per_part=4)
    assert sorted(r.id for r in out.filter("name = 'a'").collect()) == list(range(1, 21)) and sorted(r.id for r in out.filter("name = 'b'").collect()) == [21, 22, 23]
    assert numbered(spark.createDataFrame([], "name string"), ["name"], "id").collect() == []


def test_get_or_create_on_odd_rows(spark):
    table = spark.createDataFrame([("b", 7, "kept"), (None, 3, "x")], "name string, id long, more string")
    wanted = spark.createDataFrame([("z",), ("a",), ("a",), (None,), ("b",), ("",)], "name string")
    out = rel.get_or_create(table, wanted, "name", "id")
    assert sorted(((r.name, r.id, r.more) for r in out.collect()), key=str) == sorted([("b", 7, "kept"), (None, 3, "x"), ("", 8, None), ("a", 9, None), ("z", 10, None)], key=str)
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.id for r in rel.get_or_create(table.limit(0), wanted, "name", "id").collect()) == [1, 2, 3, 4]
