"""Rule predicates compiled to struct columns of built-in expressions.

A rule is a constant of the plan: its check type, keys and texts are resolved in Python, and what is left is one expression per
rule that runs in whole-stage code. Every predicate gives (is_passed, message, expected_json, actual_json, suggestion).
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docaudit.functions.text import shown, truncated
from docaudit.plans.profiles import MISSING, SYNONYMS, Rule

_NUMBERS = (int, float)


def text_of(value: Any) -> str:
    """A constant as messages print it."""
    return str(value)


def same(c: Column, kind: T.DataType, value: Any) -> Column:
    """Equality in which 14 is 14.0, and values of different kinds differ; null equals nothing."""
    if value is None:
        return c.isNull()
    numeric = isinstance(kind, T.NumericType)
    if numeric != (isinstance(value, _NUMBERS) and not isinstance(value, bool)):
        return F.lit(False)
    if numeric:
        return F.coalesce(c.cast("double") == float(value), F.lit(False))
    return F.coalesce(c == value, F.lit(False))


def as_json(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(c, {"ignoreNullFields": "false"})
    return c.cast("string")


def outcome(passed: Column, message: Column, expected: Any, actual: Column, suggestion: Column | None = None) -> Column:
    return F.struct(
        passed.alias("is_passed"), message.alias("message"), F.lit(json.dumps(expected, ensure_ascii=False)).alias("expected_json"),
        actual.alias("actual_json"), (F.lit(None).cast("string") if suggestion is None else suggestion).alias("suggestion"),
    )


def either(passed: Column, yes: Column, no: Column) -> Column:
    return F.when(passed, yes).otherwise(no)


def missing_elements(expected: list[str], actual: Column) -> Column:
    """Expected elements that no actual one holds, whatever their case, in order."""
    lowered = F.transform(F.coalesce(actual, F.array().cast("array<string>")), lambda a: F.lower(a))

    def absent(low: Column, e: str) -> Column:
        return F.when(~F.exists(low, lambda a: F.contains(a, F.lit(e.lower()))), F.lit(e))

    return computed_once(lowered, lambda low: F.array_compact(F.array(*[absent(low, e) for e in expected])))


def missing_phrases(expected: list[str], text: Column, synonyms: dict[str, list[str]]) -> Column:
    """Expected phrases of which neither they nor a synonym are in the text, whatever its case, in order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    absent = []
    for phrase in expected:
        found = F.lit(False)
        for wording in [phrase, *synonyms.get(phrase, [])]:
            found = found | F.contains(low, F.lit(wording))
        absent.append(F.when(~found, F.lit(phrase)))
    return F.array_compact(F.array(*absent))


def computed_once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _list_presence(rule: Rule, c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return computed_once(F.array_join(missing_phrases(rule.expected_value, c, SYNONYMS), ", "), lambda names: _presence_in_text(rule, c, names))
    return computed_once(F.array_join(missing_elements(rule.expected_value, c), ", "), lambda names: _presence_in_list(rule, c, kind, names))


def _presence_in_text(rule: Rule, c: Column, names: Column) -> Column:
    passed = names == ""
    message = either(passed, F.lit("Введение содержит все обязательные элементы"), F.concat(F.lit("В введении отсутствуют: "), names))
    return outcome(passed, message, rule.expected_value, truncated(F.coalesce(c, F.lit("")), 200), F.when(~passed, F.concat(F.lit("Добавьте в введение: "), names)))


def _presence_in_list(rule: Rule, c: Column, kind: T.DataType, names: Column) -> Column:
    passed = names == ""
    message = either(passed, F.lit("Все обязательные элементы присутствуют"), F.concat(F.lit("Отсутствуют элементы: "), names))
    return outcome(passed, message, rule.expected_value, as_json(c, kind), F.when(~passed, F.concat(F.lit("Добавьте недостающие элементы: "), names)))


def _equals(rule: Rule, c: Column, kind: T.DataType) -> Column:
    passed, e = same(c, kind, rule.expected_value), text_of(rule.expected_value)
    message = either(passed, F.lit(f"Соответствует требованию: {e}"), F.concat(F.lit(f"Не соответствует: ожидалось {e}, получено "), shown(c, kind)))
    return outcome(passed, message, rule.expected_value, as_json(c, kind))


def _object(rule: Rule, c: Column, kind: T.DataType, differs, absent, sep: str, yes: str, no: str) -> Column:
    fields = {f.name: f.dataType for f in kind.fields} if isinstance(kind, T.StructType) else {}
    wrong = []
    for key, value in rule.expected_value.items():
        if key in fields:
            wrong.append(F.when(~same(c[key], fields[key], value), differs(key, value, shown(c[key], fields[key]))))
        else:
            wrong.append(F.lit(absent(key)))
    issues = F.array_compact(F.array(*wrong))
    passed = F.size(issues) == 0
    return outcome(passed, either(passed, F.lit(yes), F.concat(F.lit(no), F.array_join(issues, sep))), rule.expected_value, as_json(c, kind))


def _object_equals(rule: Rule, c: Column, kind: T.DataType) -> Column:
    differs = lambda k, e, a: F.concat(F.lit(f"{k}: ожидалось {text_of(e)}, получено "), a)
    return _object(rule, c, kind, differs, lambda k: f"{k}: отсутствует в документе", "; ", "Все параметры соответствуют требованиям", "Несоответствия: ")


def _object_contains(rule: Rule, c: Column, kind: T.DataType) -> Column:
    return _object(rule, c, kind, lambda k, e, a: F.lit(f"{k} (неверное значение)"), lambda k: k, ", ", "Содержит все требуемые свойства", "Отсутствуют или неверны свойства: ")


def _bounded(rule: Rule, c: Column, kind: T.DataType, low: float | None, high: float | None, yes: str, below: str, above: str) -> Column:
    value, a = c.cast("double"), shown(c, kind)
    under = value < low if low is not None else F.lit(False)
    over = value > high if high is not None else F.lit(False)
    message = F.when(under, F.concat(F.lit("Значение "), a, F.lit(f" {below}"))).when(over, F.concat(F.lit("Значение "), a, F.lit(f" {above}"))).otherwise(F.concat(F.lit("Значение "), a, F.lit(f" {yes}")))
    return outcome(F.coalesce(~under & ~over, F.lit(False)), message, rule.expected_value, as_json(c, kind))


def _range(rule: Rule, c: Column, kind: T.DataType) -> Column:
    low, high = rule.expected_value["min"], rule.expected_value["max"]
    return _bounded(rule, c, kind, low, high, f"находится в допустимом диапазоне [{low}, {high}]", f"меньше минимально допустимого {low}", f"больше максимально допустимого {high}")


def _min_value(rule: Rule, c: Column, kind: T.DataType) -> Column:
    low = rule.expected_value
    return _bounded(rule, c, kind, low, None, f"не меньше минимально допустимого {low}", f"меньше минимально допустимого {low}", "")


def _max_value(rule: Rule, c: Column, kind: T.DataType) -> Column:
    high = rule.expected_value
    return _bounded(rule, c, kind, None, high, f"не больше максимально допустимого {high}", "", f"больше максимально допустимого {high}")


def _contains(rule: Rule, c: Column, kind: T.DataType) -> Column:
    e = rule.expected_value
    passed = F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(e.lower()))
    return outcome(passed, either(passed, F.lit(f"Текст содержит требуемое: '{e}'"), F.lit(f"Текст не содержит требуемое: '{e}'")), e, truncated(F.coalesce(c, F.lit("")), 100))


CHECKS: dict[str, Callable[[Rule, Column, T.DataType], Column]] = {
    "equals": _equals, "list_presence": _list_presence, "object_equals": _object_equals, "object_contains": _object_contains,
    "range": _range, "min_value": _min_value, "max_value": _max_value, "contains": _contains,
}


def missing_facet(rule: Rule) -> Column:
    """The outcome where the facts do not have the rule's field."""
    message, advice = MISSING.get(rule.field, (f"В документе отсутствует поле {rule.field}", None))
    return outcome(F.lit(False), F.lit(message), rule.expected_value, F.lit(None).cast("string"), F.lit(advice).cast("string"))


def compiled(rule: Rule, schema: T.StructType) -> Column:
    """A rule over facts of this schema. A null object is a missing facet, a null field in it is a value None."""
    kinds = {f.name: f.dataType for f in schema.fields}
    if rule.field not in kinds:
        return missing_facet(rule)
    if rule.check_type not in CHECKS:
        raise ValueError(f"unknown check type {rule.check_type}")
    found = CHECKS[rule.check_type](rule, F.col(rule.field), kinds[rule.field])
    if isinstance(kinds[rule.field], T.StructType):
        return F.when(F.col(rule.field).isNull(), missing_facet(rule)).otherwise(found)
    return found
