"""Rule evaluation, reports and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.functions.text import percent, score
from docaudit.operators.checks import compiled
from docaudit.operators.facts import once
from docaudit.plans.profiles import ADVICE, COMPLIANT, FAILED, MISTAKES, RETURNED, Rule

RESULT = "rule_id string, section string, rule_section string, title string, severity string, is_passed boolean, message string, expected_json string, actual_json string, suggestion string"


def evaluation_order(rules: list[Rule]) -> list[Rule]:
    """Structure, then formatting and the rest, then the introduction."""
    place = lambda r: (r.field == "introduction_text", r.rule_type != "structure")
    return sorted(rules, key=place)


def result_struct(rule: Rule, rule_no: int, schema) -> Column:
    """section is what stands before the title's first hyphen; rule_section is the rule's own."""
    o = F.struct(compiled(rule, schema).alias("o"))["o"]
    fixed = {"rule_no": rule_no, "rule_id": rule.id, "section": rule.title.split("-")[0], "rule_section": rule.section, "title": rule.title, "severity": rule.severity}
    return F.struct(*[F.lit(v).alias(k) for k, v in fixed.items()], o.alias("o"))


def result_array(facts: DataFrame, rules: list[Rule], severities: tuple[str, ...] = ()) -> Column:
    """The results of all rules (or of those of some severities) in order, as an array of structs."""
    own = [result_struct(r, i, facts.schema) for i, r in enumerate(evaluation_order(rules)) if not severities or r.severity in severities]
    return F.array(*own)


def evaluate(facts: DataFrame, rules: list[Rule], keys: tuple[str, ...] = ("doc_id",), severities: tuple[str, ...] = ()) -> DataFrame:
    """One row per document and rule. Narrow: rules are compiled to an array of structs that is unfolded in place.

    With severities, rules of others are not even computed; the numbers of the rest stay the same.
    """
    rows = facts.select(*keys, F.explode(result_array(facts, rules, severities)).alias("r"))
    return rows.select(*keys, "r.rule_no", "r.rule_id", "r.section", "r.rule_section", "r.title", "r.severity", "r.o.*")


def evaluate_section(facts: DataFrame, rules: list[Rule], section: str, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return evaluate(facts, [r for r in rules if r.section == section], keys)


def error_results(failures: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The single result of documents that could not be read or evaluated; failures has a column error."""
    none = F.lit(None).cast("string")
    return failures.select(
        *keys, F.lit(0).alias("rule_no"), F.lit("system_error").alias("rule_id"), F.lit("Система").alias("section"), F.lit("").alias("rule_section"), F.lit("Системная ошибка").alias("title"),
        F.lit("critical").alias("severity"), F.lit(False).alias("is_passed"), F.concat(F.lit("Системная ошибка при проверке: "), F.col("error")).alias("message"),
        none.alias("expected_json"), none.alias("actual_json"), F.lit("Обратитесь к администратору системы").alias("suggestion"),
    )


def failed(results: DataFrame, severity: str | None = None) -> DataFrame:
    out = results.filter(~F.col("is_passed"))
    return out.filter(F.col("severity") == severity) if severity else out


def by_severity(results: DataFrame, severity: str, failed_only: bool = False) -> DataFrame:
    """Stored results of a severity, passed ones too unless failed_only."""
    out = results.filter(F.col("severity") == severity)
    return out.filter(~F.col("is_passed")) if failed_only else out


def counters() -> list[Column]:
    bad = ~F.col("is_passed")
    return [
        F.count(F.lit(1)).alias("total_checks"), F.count_if("is_passed").alias("passed_checks"), F.count_if(bad).alias("failed_checks"),
        F.count_if(bad & (F.col("severity") == "critical")).alias("critical_issues"), F.count_if(bad & (F.col("severity") == "warning")).alias("warning_issues"),
    ]


def report(results: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counters, rate, score and flags of each document: one partial aggregation."""
    return with_scores(results.groupBy(*keys).agg(*counters()))


def with_scores(counted: DataFrame) -> DataFrame:
    passed, total = F.col("passed_checks"), F.col("total_checks")
    return counted.withColumns({
        "success_rate": percent(passed, total), "score": score(passed, total), "is_compliant": passed == F.greatest(total, F.lit(1)), "has_critical": F.col("critical_issues") > 0,
    })


def nested_report(results: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Report rows with their results as an array in rule order; a document has as many as there are rules. One grouping."""
    fields = ["rule_id", "section", "title", "severity", "is_passed", "message", "expected_json", "actual_json", "suggestion"]
    details = F.when(F.col("suggestion").isNotNull(), F.struct("suggestion")).alias("details")
    own = F.transform(F.sort_array(F.collect_list(F.struct("rule_no", F.struct(*fields, details).alias("r")))), lambda x: x["r"])
    return with_scores(results.groupBy(*keys).agg(*counters(), own.alias("results")))


def reports(facts: DataFrame, rules: list[Rule], keys: tuple[str, ...] = ("doc_id",), nested: bool = False) -> DataFrame:
    """The report of each row of facts without result rows between: narrow. With `nested`, results as an array in rule order too."""
    rows = once(facts.select(*keys, *[c for c in facts.columns if c not in keys]), found=result_array(facts, rules))
    bad = lambda severity: F.size(F.filter("found", lambda r: ~r["o"]["is_passed"] & (r["severity"] == severity))).cast("long")
    passed = F.size(F.filter("found", lambda r: r["o"]["is_passed"])).cast("long")
    counted = rows.select(
        *keys, F.size("found").cast("long").alias("total_checks"), passed.alias("passed_checks"), (F.size("found") - passed).alias("failed_checks"), bad("critical").alias("critical_issues"), bad("warning").alias("warning_issues"),
        *[F.transform("found", flat).alias("results")] * nested,
    )
    return with_scores(counted)


def flat(r: Column) -> Column:
    """A result of result_array as reports hold it."""
    o = r["o"]
    details = F.when(o["suggestion"].isNotNull(), F.struct(o["suggestion"].alias("suggestion")))
    return F.struct(*[r[n].alias(n) for n in ("rule_id", "section", "title", "severity")], *[o[n].alias(n) for n in ("is_passed", "message", "expected_json", "actual_json", "suggestion")], details.alias("details"))


def status(reports: DataFrame) -> DataFrame:
    """The document's next status and score."""
    return reports.withColumn("status", F.when(F.col("total_checks") == 0, FAILED).when(F.col("is_compliant"), COMPLIANT).otherwise(RETURNED))


def mistakes(results: DataFrame) -> DataFrame:
    """Rows for each failed critical or warning result, with the type and level that its severity stands for."""
    pairs = [F.lit(x) for k, v in MISTAKES.items() for x in (k, F.array(*map(F.lit, v)))]
    kind = F.create_map(*pairs)[F.col("severity")]
    return failed(results).filter(F.col("severity").isin(*MISTAKES)).withColumn("mistake_type", kind[0]).withColumn("critical_status", kind[1])


def issue_rows(results: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Errors and warnings as rows of one table, in one pass over the results."""
    critical = F.col("severity") == "critical"
    kind, level = F.when(critical, "Ошибка").otherwise("Замечание"), F.when(critical, "Критично").otherwise("Средний")
    own = failed(results).filter(F.col("severity").isin("critical", "warning"))
    return own.select(*keys, kind.alias("type"), F.lit("ГОСТ").alias("category"), level.alias("level"), F.lit("-").alias("page"), F.col("message").alias("description"))


def recommendations(results: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Suggestions of a document's failed results, then general advice, which comes with its result number 0. One pass, no shuffle."""
    advice = F.array(*[F.struct(F.lit(100 + i).alias("place"), F.lit("Общие").alias("section"), F.lit(t).alias("suggestion"), F.lit("info").alias("severity")) for i, t in enumerate(ADVICE)])
    none = F.filter(advice, lambda x: F.lit(False))
    own = F.when(~F.col("is_passed") & F.col("suggestion").isNotNull(), F.array(F.struct(F.col("rule_no").alias("place"), "section", "suggestion", "severity"))).otherwise(none)
    return results.select(*keys, F.inline(F.concat(own, F.when(F.col("rule_no") == 0, advice).otherwise(none))))


def result_view(checks: DataFrame, documents: DataFrame, default_name: str = "unknown") -> DataFrame:
    """Stored results (check_id, document_id, result as JSON) next to their document, with fallbacks for rows that do not parse."""
    schema = f"total_checks int, passed_checks int, failed_checks int, score int, is_compliant boolean, results array<struct<{', '.join(f.replace(' ', ':', 1) for f in RESULT.split(', '))}>>"
    parsed = checks.withColumn("r", F.from_json("result", schema))
    joined = parsed.join(documents.select("document_id", "filename", F.col("score").alias("own_score")), "document_id", "left")
    of = lambda s: F.filter(F.coalesce("r.results", F.array().cast(f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in RESULT.split(', '))}>>")), lambda x: x["severity"] == s)
    return joined.select(
        "check_id", "document_id", F.coalesce("filename", F.lit(default_name)).alias("filename"), F.coalesce("r.total_checks", F.lit(0)).alias("total_checks"), F.coalesce("r.passed_checks", F.lit(0)).alias("passed_checks"),
        F.coalesce("own_score", "r.score", F.lit(0)).alias("score"), F.coalesce("r.is_compliant", F.lit(False)).alias("is_compliant"), of("critical").alias("critical_issues"), of("warning").alias("warnings"),
    )
