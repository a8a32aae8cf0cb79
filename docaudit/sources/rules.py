"""Rule sets from JSON, and what is said of them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.plans.profiles import Rule

RULE_SCHEMA = "rule_no int, id string, section string, title string, content string, rule_type string, field string, expected_json string, check_type string, severity string, description string, unit string"
GROUPS = ("structure", "formatting")


def load_rules(spark: SparkSession, path: str) -> list[Rule]:
    """Rules of a JSON file that any Spark file system holds; a missing file is an error. A later rule replaces one with its id."""
    text = "".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    groups = json.loads(text)["rules"]
    by_id: dict[str, Rule] = {}
    for group in GROUPS:
        for rule in groups.get(group, {}).values():
            by_id[rule["id"]] = Rule(**{k: rule.get(k) for k in Rule.__dataclass_fields__})
    return list(by_id.values())


def rules_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    rows = [(i, r.id, r.section, r.title, r.content, r.rule_type, r.field, json.dumps(r.expected_value, ensure_ascii=False), r.check_type, r.severity, r.description, r.unit) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def by_section(rules: list[Rule], section: str) -> list[Rule]:
    return [r for r in rules if r.section == section]


def by_id(rules: list[Rule], rule_id: str) -> Rule | None:
    return next((r for r in rules if r.id == rule_id), None)


def exported(rules: DataFrame) -> DataFrame:
    return rules.select("id", "section", "title", F.coalesce("description", F.lit("")).alias("description"), F.col("rule_type").alias("type"), "severity", "check_type", F.col("expected_json").alias("expected_value"))


def summary(rules: DataFrame) -> DataFrame:
    """Number of rules, by type and by severity."""
    is_ = lambda c, v: F.count_if(F.col(c) == v)
    return rules.agg(
        F.count(F.lit(1)).alias("total_rules"), is_("rule_type", "structure").alias("structure"), is_("rule_type", "formatting").alias("formatting"), is_("rule_type", "content").alias("content"),
        is_("severity", "critical").alias("critical"), is_("severity", "warning").alias("warning"), is_("severity", "info").alias("info"),
    )


def grouped(rules: DataFrame) -> DataFrame:
    """Rules of each section in order."""
    return rules.groupBy("section").agg(F.transform(F.sort_array(F.collect_list(F.struct("rule_no", "id", "title", "severity"))), lambda x: F.struct(x["id"].alias("id"), x["title"].alias("title"), x["severity"].alias("severity"))).alias("rules"))
