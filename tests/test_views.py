"""Stored results of any shape, doubles as Python rounds and prints them, the API's SQL functions."""

import math
import random
import re
import struct

import duckdb
import pytest
from pyspark.sql import functions as F

from docaudit.functions import text as fn
from docaudit.operators import stored
from docaudit.plans import api, catalogue, flows

DATA = "/root/testdata/sf0.001"


# Numbers

rnd = random.Random(1)
SPECIAL = [2.675, 0.125, 0.375, 2.5, -2.675, 1e-5, 1e16, 1e22, 1 / 3, 100.0, 0.0, -0.0, 1e15, 9007199254740993.0, math.nan, math.inf, -math.inf, 2e23, 8.41e21, 1e-7, 1.7976931348623157e308, 0.5, 1.5, 2.0**52 + 0.5, 1e-4, 0.00012345, 5.684341886080802e-14]
NUMBERS = [
    *SPECIAL, *[rnd.uniform(-1000, 1000) for _ in range(300)], *[round(rnd.uniform(-100, 100), rnd.randrange(1, 5)) for _ in range(300)], *[rnd.randrange(10**6) / 8 for _ in range(200)],
    *[x for x in (struct.unpack("d", struct.pack("Q", rnd.getrandbits(64)))[0] for _ in range(300)) if not 0 < abs(x) < 1e-300], *[10.0**k for k in range(-20, 25)], *[2.0**k for k in range(-60, 70)], *[math.nextafter(2.0**k, 0) for k in range(-50, 62)],
]


@pytest.fixture(scope="module")
def numbers(spark):
    df = spark.createDataFrame([(x,) for x in [*NUMBERS, None]], "x double")
    return df.select("x", fn.number_text(F.col("x")).alias("shown"), *[fn.half_even(F.col("x"), p).alias(f"r{p}") for p in range(4)]).collect()


def test_doubles_are_printed_as_python_prints_them(numbers):
    assert [(r.x, r.shown) for r in numbers if r.x is not None and r.shown != repr(r.x)] == []
    assert next(r for r in numbers if r.x is None).shown is None


def test_doubles_are_rounded_by_their_binary_value(numbers):
    for r in numbers:
        for p in range(4):
            want = r.x if r.x is None or not math.isfinite(r.x) else round(r.x, p)
            assert r[f"r{p}"] == want or (want is not None and math.isnan(want) and math.isnan(r[f"r{p}"])), (r.x, p)
    with pytest.raises(ValueError):
        fn.half_even(F.lit(1.0), 4)


def test_doubles_are_rounded_half_up_as_sql_rounds_them(spark):
    con = duckdb.connect()
    values = [2.985 * 10, 29.85, 1.005, 0.15, -29.849999999999998, 1e308, 0.0, *NUMBERS[len(SPECIAL) : 1000]]
    for r in spark.createDataFrame([(x,) for x in values], "x double").select("x", *[fn.half_up(F.col("x"), p).alias(f"r{p}") for p in (0, 1, 2, 4)]).collect():
        assert tuple(r)[1:] == con.execute("SELECT round($1, 0), round($1, 1), round($1, 2), round($1, 4)", [r.x]).fetchone(), r.x
    odd = spark.createDataFrame([(None,), (math.inf,), (math.nan,)], "x double").select(fn.half_up(F.col("x"), 1).alias("r")).collect()
    assert odd[0].r is None and odd[1].r == math.inf and math.isnan(odd[2].r)


def test_clamped_scores_match_their_sql_where_digits_and_product_part(spark, tmp_path):
    spark.createDataFrame([(4493, 2985.0), (1, -3.0), (2, 12000.0), (3, None)], "c_custkey long, c_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{tmp_path}/customer.parquet/*.parquet')")
    assert sorted(map(tuple, catalogue.clamp_score(spark, str(tmp_path)).collect())) == sorted(con.execute(catalogue.SQL["clamp_score"]).fetchall())


# Stored results


def test_results_of_odd_rows(spark):
    rows = [
        (1, 1, None), (2, 1, ""), (3, 1, "  "), (4, 1, "{"), (5, 2, "7"), (6, None, '"text"'), (7, 9, '{"score": true, "report": {"results": [[], 3, {"severity": ["critical"]}, {"severity": "critical"}]}}'), (8, 2, '{"report": [1], "passed_checks": "12"}'),
        (1, 1, '{"score": 5}'),
    ]
    checks = spark.createDataFrame(rows, "check_id int, document_id int, result string")
    documents = spark.createDataFrame([(1, "a", None), (2, None, 7)], "document_id int, filename string, score int")
    got = sorted(map(tuple, stored.stored_results(checks, documents).collect()), key=str)
    assert got == sorted([
        (1, 1, "a", True, 0.0, False, 0.0, 0.0, [], []), (2, 1, "a", True, 0.0, False, 0.0, 0.0, [], []), (3, 1, "a", True, 0.0, False, 0.0, 0.0, [], []), (4, 1, "a", False, 0.0, False, 0.0, 0.0, [stored.UNREADABLE], []),
        (5, 2, "unknown", True, 7.0, False, 0.0, 0.0, [], []), (6, None, "unknown", True, 0.0, False, 0.0, 0.0, [], []), (7, 9, "unknown", True, 1.0, False, 0.0, 0.0, [stored.NO_ERROR], []), (8, 2, "unknown", True, 7.0, False, 0.0, 12.0, [], []),
        (1, 1, "a", True, 5.0, False, 0.0, 0.0, [], []),
    ], key=str)
    assert stored.stored_results(checks.limit(0), documents).count() == 0
    assert [r.score for r in stored.shown_results(stored.stored_results(checks.filter("check_id = 5"))).collect()] == ["0.0"]


# The API


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_parameters_reach_the_scan(spark):
    api.install(spark, flows.api_tables(spark, DATA))
    assert "EqualTo(o_orderkey,40)" in plan_of(api.call(spark, "document_by_id", 40, 0, True)).replace(" ", "")
    own = plan_of(api.call(spark, "document_by_id", 40, 7, False)).replace(" ", "")
    assert "EqualTo(o_orderkey,40)" in own and "EqualTo(o_custkey,7)" in own
    # the list of pushed filters is cut short in plans
    assert re.search(r"Filter[^\n]*l_orderkey#\d+L = 40", plan_of(api.call(spark, "mistakes_by_document", 40, 0, True)))


def test_rows_are_seen_by_their_owners(spark):
    api.install(spark, flows.api_tables(spark, DATA))
    owner = api.call(spark, "document_by_id", 40, 0, True).first().user_id
    counts = [api.call(spark, name, 40, *who).count() for name in ("document_by_id", "document_full_info", "mistakes_by_document") for who in ((owner, False), (owner + 1, False))]
    assert counts[:4] == [1, 0, 1, 0] and counts[5] == 0
    assert api.call(spark, "all_documents", 1, False).count() == 0 and api.call(spark, "document_by_id", None, None, None).count() == 0
    assert api.call(spark, "standard_by_name", "FRANCE", "1.0").count() + api.call(spark, "standard_by_name", "FRANCE", None).count() <= 1
    assert api.call(spark, "standard_by_name", "x' OR '1'='1", None).count() == 0


def test_functions_need_their_tables(spark):
    api.install(spark, {"users": spark.createDataFrame([(1, True)], "user_id long, is_admin boolean")}, prefix="few_")
    assert api.call(spark, "user_by_id", 1, 1, False, prefix="few_").count() == 1
    with pytest.raises(Exception, match="few_all_documents"):
        api.call(spark, "all_documents", 1, True, prefix="few_").count()
    with pytest.raises(ValueError, match="unknown table"):
        api.install(spark, {"other": spark.range(1)})
