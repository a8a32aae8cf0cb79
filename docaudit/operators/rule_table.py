"""Rules of many standards as rows: joined to documents by standard and evaluated by one expression, however many there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docaudit.functions.text import shown, truncated
from docaudit.operators.checks import as_json, computed_once
from docaudit.plans.profiles import MISSING, SYNONYMS

RULES = "standard_id long, rule_no int, id string, section string, title string, content string, rule_type string, field string, expected variant, check_type string, severity string, description string, unit string"
GROUPS = ("structure", "formatting")
#: A fact: its kind, how messages print it, and its value by kind; fields are those of an object.
_FIELD = "struct<kind:string,shown:string,text:string,number:double,flag:boolean>"
FACT = f"struct<kind:string,shown:string,text:string,number:double,flag:boolean,items:array<string>,fields:map<string,{_FIELD}>,json:string>"


# Rules


def rule_sets(texts: DataFrame, standard: str = "standard_id", text: str = "text") -> DataFrame:
    """Rows of rules (RULES) from rule sets as JSON, one text a standard: the structure group, then the formatting group.

    A later rule of a set replaces one with its id. The expected value keeps whatever shape it has. Texts that are no rule sets give
    no rules; groups are objects of rules.
    """
    sets = texts.select(F.col(standard).cast("long").alias("standard_id"), F.try_parse_json(text).alias("j"))
    groups = [F.struct(F.lit(i).alias("g"), F.try_variant_get("j", f"$.rules.{name}", "variant").alias("rules")) for i, name in enumerate(GROUPS)]
    named = sets.select("standard_id", F.inline(F.array(*groups))).withColumn("rules", F.try_variant_get("rules", "$", "map<string,variant>"))
    rules = named.select("standard_id", "g", F.posexplode("rules").alias("p", "name", "rule"))
    get = lambda name: F.try_variant_get("rule", f"$.{name}", "string").alias(name)
    texts_of = ["id", "section", "title", "content", "rule_type", "field", "check_type", "severity", "description", "unit"]
    rows = rules.select("standard_id", F.struct("g", "p").alias("at"), *[get(c) for c in texts_of], F.try_variant_get("rule", "$.expected_value", "variant").alias("expected"))
    # of rules with one id the last counts, in the place where the first stood
    last = rows.filter("id is not null").groupBy("standard_id", "id").agg(F.min("at").alias("first"), F.max_by(F.struct(*[c for c in texts_of if c != "id"], "expected"), "at").alias("r"))
    placed = last.select("standard_id", (F.col("first.g") * 1_000_000 + F.col("first.p")).alias("rule_no"), "id", "r.*")
    return placed.select(*[c.split(" ")[0] for c in RULES.split(", ")])


def exported(rules: DataFrame) -> DataFrame:
    """Rules as the API shows them."""
    return rules.select("standard_id", "id", "section", "title", F.coalesce("description", F.lit("")).alias("description"), F.col("rule_type").alias("type"), "severity", "check_type", F.to_json("expected").alias("expected_value"))


def summary(rules: DataFrame) -> DataFrame:
    """Each standard's number of rules, by type and by severity."""
    is_ = lambda c, v: F.count_if(F.col(c) == v).alias(v)
    return rules.groupBy("standard_id").agg(
        F.count(F.lit(1)).alias("total_rules"), *[is_("rule_type", v) for v in ("structure", "formatting", "content")], *[is_("severity", v) for v in ("critical", "warning", "info")]
    )


def by_section(rules: DataFrame) -> DataFrame:
    """Each section's rules of a standard, in order."""
    own = F.sort_array(F.collect_list(F.struct("rule_no", "id", "title", "severity")))
    return rules.groupBy("standard_id", "section").agg(F.transform(own, lambda r: F.struct(r["id"].alias("id"), r["title"].alias("title"), r["severity"].alias("severity"))).alias("rules"))


# Facts


def _kind(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "flag"
    if isinstance(kind, T.NumericType):
        return "number"
    return "list" if isinstance(kind, T.ArrayType) else "object" if isinstance(kind, (T.StructType, T.MapType)) else "text"


def _scalar(c: Column, kind: T.DataType) -> list[Column]:
    name, none = _kind(kind), F.lit(None)
    return [
        F.when(c.isNotNull(), F.lit(name)).alias("kind"), shown(c, kind).alias("shown"), (c if name == "text" else none).cast("string").alias("text"),
        (c if name == "number" else none).cast("double").alias("number"), (c if name == "flag" else none).cast("boolean").alias("flag"),
    ]


def fact(c: Column, kind: T.DataType) -> Column:
    """A fact of any type as FACT. A null object or list is a missing fact, a null scalar one that is None."""
    if isinstance(kind, T.StructType):
        fields = [x for f in kind.fields for x in (F.lit(f.name), F.struct(*_scalar(c[f.name], f.dataType)))]
        body = F.struct(F.lit("object").alias("kind"), as_json(c, kind).alias("shown"), *[F.lit(None).cast(t).alias(n) for n, t in (("text", "string"), ("number", "double"), ("flag", "boolean"), ("items", "array<string>"))], F.create_map(*fields).alias("fields"), as_json(c, kind).alias("json"))
        return F.when(c.isNotNull(), body.cast(FACT))
    items = c.cast("array<string>") if isinstance(kind, T.ArrayType) else F.lit(None).cast("array<string>")
    scalar = _scalar(c, kind)
    if isinstance(kind, T.ArrayType):
        scalar = [F.lit("list").alias("kind"), shown(c, kind).alias("shown"), *[F.lit(None).cast(t).alias(n) for n, t in (("text", "string"), ("number", "double"), ("flag", "boolean"))]]
    return F.struct(*scalar, items.alias("items"), F.lit(None).cast(f"map<string,{_FIELD}>").alias("fields"), as_json(c, kind).alias("json")).cast(FACT)


def fact_maps(facts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys and facts, a map from the names of all other columns to FACT: the plan grows with the kinds of facts, not with rules."""
    kinds = {f.name: f.dataType for f in facts.schema.fields if f.name not in keys}
    return facts.select(*keys, F.create_map(*[x for name, kind in kinds.items() for x in (F.lit(name), fact(F.col(name), kind))]).alias("facts"))


# Evaluation


def typed(rules: DataFrame) -> DataFrame:
    """Rules with their expected value read once a rule: e_kind, e_text, e_number, e_items, e_fields; fields of an object come by name."""
    kind = F.schema_of_variant("expected")
    of = lambda v: F.when(F.schema_of_variant(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), "number").when(F.schema_of_variant(v) == "STRING", "text").when(F.schema_of_variant(v) == "BOOLEAN", "flag")
    printed = lambda v: F.when(of(v) == "flag", F.when(F.try_variant_get(v, "$", "boolean"), "True").otherwise("False")).otherwise(F.try_variant_get(v, "$", "string"))
    scalar = lambda v: F.struct(of(v).alias("kind"), printed(v).alias("shown"), F.try_variant_get(v, "$", "string").alias("text"), F.when(of(v) == "number", F.try_variant_get(v, "$", "double")).alias("number"), F.when(of(v) == "flag", F.try_variant_get(v, "$", "boolean")).alias("flag"))
    fields = F.transform(F.map_entries(F.try_variant_get("expected", "$", "map<string,variant>")), lambda e: F.struct(e["key"].alias("name"), scalar(e["value"]).alias("value")))
    return rules.withColumns({
        "e_kind": F.when(kind.startswith("ARRAY"), "list").when(kind.startswith("OBJECT"), "object").otherwise(of(F.col("expected"))), "e_shown": F.when(of(F.col("expected")).isNotNull(), printed(F.col("expected"))),
        "e_number": F.when(of(F.col("expected")) == "number", F.try_variant_get("expected", "$", "double")), "e_flag": F.when(of(F.col("expected")) == "flag", F.try_variant_get("expected", "$", "boolean")), "e_items": F.when(kind.startswith("ARRAY"), F.try_variant_get("expected", "$", "array<string>")),
        "e_fields": F.when(kind.startswith("OBJECT"), F.array_sort(fields, lambda a, b: F.when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0))),
        "e_min": F.try_variant_get("expected", "$.min", "double"), "e_max": F.try_variant_get("expected", "$.max", "double"), "e_min_shown": F.try_variant_get("expected", "$.min", "string"), "e_max_shown": F.try_variant_get("expected", "$.max", "string"),
        "expected_json": F.to_json("expected"),
    })


def _same(f: Column, e: Column) -> Column:
    """Equality in which 14 is 14.0 and values of different kinds differ; None equals only an expected null."""
    value = F.when(e["kind"] == "number", f["number"] == e["number"]).when(e["kind"] == "flag", f["flag"] == e["flag"]).otherwise(f["text"] == e["text"])
    return F.when(e["kind"].isNull(), f["kind"].isNull()).otherwise(F.coalesce((f["kind"] == e["kind"]) & value, F.lit(False)))


def _outcome(passed: Column, message: Column, suggestion: Column | None = None) -> Column:
    return F.struct(F.coalesce(passed, F.lit(False)).alias("is_passed"), message.alias("message"), (F.lit(None).cast("string") if suggestion is None else suggestion).alias("suggestion"))


def _said(passed: Column, yes: Column | str, no: Column) -> Column:
    return F.when(passed, yes).otherwise(no)


def _texts(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _list_presence(f: Column) -> Column:
    pairs = [x for k, v in SYNONYMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]
    wordings = F.create_map(*pairs)
    low = F.lower(F.coalesce(f["text"], F.lit("")))
    lows = F.transform(F.coalesce(f["items"], F.array().cast("array<string>")), F.lower)
    in_text = computed_once(low, lambda t: F.filter("e_items", lambda e: ~F.exists(F.concat(F.array(e), F.coalesce(F.try_element_at(wordings, e), F.array().cast("array<string>"))), lambda w: F.contains(t, w))))
    in_list = computed_once(lows, lambda xs: F.filter("e_items", lambda e: ~F.exists(xs, lambda x: F.contains(x, F.lower(e)))))
    is_text = F.coalesce(f["kind"], F.lit("text")) == "text"
    found = F.array_join(F.when(is_text, in_text).otherwise(in_list), ", ")

    def said(names: Column) -> Column:
        passed = names == ""
        message = F.when(passed, F.when(is_text, "Введение содержит все обязательные элементы").otherwise("Все обязательные элементы присутствуют")).otherwise(_texts(F.when(is_text, "В введении отсутствуют: ").otherwise("Отсутствуют элементы: "), names))
        return _outcome(passed, message, F.when(~passed, _texts(F.when(is_text, "Добавьте в введение: ").otherwise("Добавьте недостающие элементы: "), names)))

    return computed_once(found, said)


def _object(f: Column, exact: bool) -> Column:
    def wrong(e: Column) -> Column:
        own = F.try_element_at(f["fields"], e["name"])
        differs = _texts(e["name"], ": ожидалось ", F.coalesce(e["value"]["shown"], F.lit("None")), ", получено ", own["shown"]) if exact else _texts(e["name"], " (неверное значение)")
        return F.when(own.isNull(), _texts(e["name"], ": отсутствует в документе") if exact else e["name"]).when(~_same(own, e["value"]), differs)

    yes, no = ("Все параметры соответствуют требованиям", "Несоответствия: ") if exact else ("Содержит все требуемые свойства", "Отсутствуют или неверны свойства: ")
    issues = F.array_join(F.array_compact(F.transform("e_fields", wrong)), "; " if exact else ", ")
    return computed_once(issues, lambda x: _outcome(x == "", _said(x == "", F.lit(yes), _texts(no, x))))


def _bounded(f: Column, low: Column, high: Column, yes: Column, low_text: Column, high_text: Column) -> Column:
    value = lambda *rest: _texts("Значение ", f["shown"], *rest)
    under, over = F.coalesce(f["number"] < low, F.lit(False)), F.coalesce(f["number"] > high, F.lit(False))
    passed = f["number"].isNotNull() & ~under & ~over
    return _outcome(passed, F.when(under, value(" меньше минимально допустимого ", low_text)).when(over, value(" больше максимально допустимого ", high_text)).otherwise(value(" ", yes)))


def outcome(f: Column) -> Column:
    """The outcome of a row's rule (the columns of typed) on a fact."""
    scalar = F.struct(F.col("e_kind").alias("kind"), F.col("e_shown").alias("text"), F.col("e_number").alias("number"), F.col("e_flag").alias("flag"))
    equal = _same(f, scalar)
    part = _texts("'", F.col("e_shown"), "'")
    held = F.contains(F.lower(F.coalesce(f["text"], F.lit(""))), F.lower("e_shown"))
    nothing = F.lit(None).cast("double")
    checks = {
        "equals": _outcome(equal, _said(equal, _texts("Соответствует требованию: ", F.col("e_shown")), _texts("Не соответствует: ожидалось ", F.col("e_shown"), ", получено ", f["shown"]))),
        "list_presence": _list_presence(f), "object_equals": _object(f, True), "object_contains": _object(f, False),
        "range": _bounded(f, F.col("e_min"), F.col("e_max"), _texts("находится в допустимом диапазоне [", F.col("e_min_shown"), ", ", F.col("e_max_shown"), "]"), F.col("e_min_shown"), F.col("e_max_shown")),
        "min_value": _bounded(f, F.col("e_number"), nothing, _texts("не меньше минимально допустимого ", F.col("e_shown")), F.col("e_shown"), F.lit("")),
        "max_value": _bounded(f, nothing, F.col("e_number"), _texts("не больше максимально допустимого ", F.col("e_shown")), F.lit(""), F.col("e_shown")),
        "contains": _outcome(held, _said(held, _texts("Текст содержит требуемое: ", part), _texts("Текст не содержит требуемое: ", part))),
    }
    missing = [x for k, v in MISSING.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]
    said = F.coalesce(F.try_element_at(F.create_map(*missing), F.col("field")), F.array(_texts("В документе отсутствует поле ", F.col("field")), F.lit(None).cast("string")))
    out = F.when(f.isNull(), _outcome(F.lit(False), said[0], said[1]))
    for name, c in checks.items():
        out = out.when(F.col("check_type") == name, c)
    return out.otherwise(_outcome(F.lit(False), _texts("Неизвестный тип проверки: ", F.col("check_type"))))


def evaluate(facts: DataFrame, rules: DataFrame, standard: str, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each document and rule of the document's standard: keys, standard, rule_no, rule_id, section, title, severity,
    is_passed, message, expected_json, actual_json, suggestion.

    facts has keys, the column standard, and facts under the names that rules call them. The plan is the same for any number of rules
    and standards. Documents meet their rules in one equi-join, which the engine broadcasts if the rules are few and splits if a
    standard has very many documents. Documents of unknown standards, or without one, have no rows; a rule that names a fact that
    there is not fails with the message for it; a check of unknown type fails; repeated documents and rules count each.
    """
    rows = fact_maps(facts, (*keys, standard)).join(typed(rules).withColumnRenamed("standard_id", standard), standard)
    rows = rows.select(*keys, standard, "rule_no", F.col("id").alias("rule_id"), "section", "title", "severity", "expected_json", "field", "check_type", *[c for c in ("e_kind", "e_shown", "e_number", "e_flag", "e_items", "e_fields", "e_min", "e_max", "e_min_shown", "e_max_shown")], F.try_element_at("facts", F.col("field")).alias("fact"))
    found = rows.withColumn("o", outcome(F.col("fact")))
    return found.select(*keys, standard, "rule_no", "rule_id", F.split("title", "-", 2)[0].alias("section"), F.col("section").alias("rule_section"), "title", "severity", "o.is_passed", "o.message", "expected_json", truncated(F.col("fact.json"), 200).alias("actual_json"), "o.suggestion")
