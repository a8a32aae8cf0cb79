"""Facts of pages and glyphs against a plain version, in small batches and on odd rows; the plan of the query."""

import random
import re
from collections import Counter

import pytest

from docaudit.operators import facts as fx
from docaudit.plans import catalogue
from docaudit.plans.profiles import TITLE_WORDS_PAGES

rnd = random.Random(3)
HEADS = ("содержание", "оглавление", "определения", "обозначения и сокращения", "введение", "заключение", "список использованных", "список литературы", "список источников", "приложения")


def half_even(x, places):
    """As the engine rounds: by the printed digits."""
    from decimal import ROUND_HALF_EVEN, Decimal

    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_EVEN))


def brute(pages, glyphs):
    out = {}
    for doc in {p[0] for p in pages if p[0] is not None}:
        sheets, elements, first_line, gaps, firsts, ink_x0, ink_x1, ys0, ys1 = {}, [], {}, [], [], [], [], [], []
        fonts, sizes = Counter(), Counter()
        for p in pages:
            if p[0] == doc and p[1] is not None:
                sheets.setdefault(p[1], p)
        for n in sorted(sheets):
            own = sorted((g for g in glyphs if g[:2] == (doc, n)), key=lambda g: g[2])
            size = [g[5] or 0.0 for g in own]
            mean = sum(size) / len(size) if size else None
            big = {g[3] for g, s in zip(own, size) if s > mean + 1 and g[3] is not None}
            text = sheets[n][2] or ""
            for line in filter(None, (x.strip() for x in text.split("\n"))):
                low = line.lower()
                if low.startswith(HEADS) or re.match(r"\d+\.?\s?\w+|глава \d+", low) or any(b in line for b in big):
                    e = re.sub(r"^\d+\.?\s*", "", low)
                    if e not in elements:
                        elements.append(e)
                        first_line[e] = line
            if n == 1 and any(w in text.lower() for w in TITLE_WORDS_PAGES) and "титульный лист" not in elements:
                elements.append("титульный лист")
            for g, s in zip(own, size):
                if (g[3] or "").strip():
                    font = re.sub(r"-(Regular|Bold|Italic|BoldItalic)$", "", re.sub(r"^[A-Z]{6}\+", "", g[4] or ""))
                    fonts.update([font] if font else [])
                    sizes.update([half_even(s, 1)] if half_even(s, 1) else [])
                    ink_x0 += [g[6]] if g[6] is not None else []
                    ink_x1 += [g[7]] if g[7] is not None else []
                ys0 += [g[8]] if g[8] is not None else []
                ys1 += [g[9]] if g[9] is not None else []
            ys = sorted({half_even(g[8] or 0.0, 1) for g in own}, reverse=True)
            gaps += [a - b for a, b in zip(ys, ys[1:]) if 0.5 * mean < a - b < 3 * mean]
            anchor, xs = None, []
            for y, x, s in sorted((-(g[9] or 0.0), g[6] or 0.0, g[5] or 0.0) for g in own):
                if anchor is None or abs(anchor - y) > 0.5 * mean:
                    anchor = y
                    xs += [x] if s <= mean + 1 else []
            firsts += [sum(xs) / len(xs)] if xs else []
        if any(re.match(r"\d+\.", line) for line in first_line.values()):
            elements.append("основная часть")
        mode = lambda c: max(c.items(), key=lambda x: x[1])[0] if c else None
        width, height = (sheets[min(sheets)][3] or 595.0), (sheets[min(sheets)][4] or 842.0)
        mm = lambda v: None if v is None else max(half_even(v * 0.3528, 1), 0.0)
        low, high = (lambda v: min(v, default=None)), (lambda v: max(v, default=None))
        minus = lambda a, b: None if b is None else a - b
        first_x = sum(firsts) / len(firsts) if firsts else None
        indent = None if first_x is None or not ink_x0 else half_even((first_x - min(ink_x0)) / 28.346, 2)
        spacing = half_even(sum(gaps) / len(gaps) / (mode(sizes) or 14.0), 1) if gaps else None
        size = None if mode(sizes) is None else int(half_even(mode(sizes), 0))
        # greatest() ignores nulls: a margin without ink is 0
        margins = tuple(0.0 if v is None else v for v in (mm(low(ink_x0)), mm(minus(width, high(ink_x1))), mm(minus(height, high(ys1))), mm(low(ys0))))
        out[doc] = (elements, (mode(fonts), size, spacing), margins, indent, len(sheets), "".join((sheets[n][2] or "") + " " for n in sorted(sheets)))
    return out


def found(spark, pages, glyphs):
    rows = fx.page_facts(spark.createDataFrame(pages, fx.PAGES), spark.createDataFrame(glyphs, fx.CHARS)).collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    return {r.doc_id: (r.required_elements, tuple(r.font_settings), tuple(r.page_margins), r.paragraph_indent, r.page_count, r.full_text) for r in rows}


LINES = ["Введение", "1. Глава", "Глава", "2 Итоги", "просто текст", "студент", "Заключение", "", "  ", "AB C", "1. Глава", "Приложения"]


def some_pages(n_docs):
    pages, glyphs = [], []
    for d in range(n_docs):
        for n in rnd.sample(range(1, 5), rnd.randrange(1, 4)):
            pages.append((f"d{d}", n, rnd.choice(["\n".join(rnd.choices(LINES, k=rnd.randrange(6))), None]), rnd.choice([595.0, None]), 842.0))
            for c in range(rnd.choice([0, 1, 2, 9, 40])):
                y = rnd.choice([None, rnd.randrange(0, 800) / 4])
                glyphs.append((f"d{d}", n, c, rnd.choice("ABC \n") if rnd.random() < 0.95 else None, rnd.choice(["ABCDEF+Arial-Bold", "Times", None, ""]), rnd.choice([None, 10.0, 12.0, 14.25, 20.0]), rnd.choice([None, 50.0, 60.5]), rnd.choice([None, 500.0]), y, None if y is None else y + 10))
    return pages, glyphs


@pytest.mark.parametrize("rows", [3, 10000])
def test_page_facts_equal_plain_ones(spark, rows):
    pages, glyphs = some_pages(40)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        got, expected = found(spark, pages, glyphs), brute(pages, glyphs)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for doc, facts in expected.items():
        assert got[doc] == facts, doc
    assert set(got) == set(expected)


def test_odd_pages(spark):
    glyph = (0, "A", "Times", 10.0, 1.0, 2.0, 3.0, 4.0)
    pages = [("a", 1, "Введение", 100.0, 200.0), (None, 1, "x", 1.0, 1.0), ("n", None, "x", 1.0, 1.0), ("empty", 1, None, None, None)]
    glyphs = [("a", 1, *glyph), ("a", 2, *glyph), ("b", 1, *glyph), (None, 1, *glyph), ("a", None, *glyph)]
    got = found(spark, pages, glyphs)
    assert set(got) == {"a", "empty"} and got["a"][4] == 1 and got["empty"][:2] == ([], (None, None, None)) and got["a"][1][0] == "Times"
    assert found(spark, pages + [("a", 1, "other", 1.0, 1.0)], glyphs)["a"][4] == 1
    assert found(spark, [], glyphs) == {}


def test_the_query_scans_once_and_deals_twice(spark):
    plan = catalogue.page_facts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) <= 2 and plan.count("FileScan") == 1 and "Join" not in plan


def test_larger_tables_are_dealt_to_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(fx, "ROWS_PER_TASK", 100)
    rows = spark.range(10)
    assert fx.dealt(rows, 2_050, "id").rdd.getNumPartitions() == 21
    n = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    plan = catalogue.page_facts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert re.findall(r"RepartitionByExpression \[.*?\], (\d+)", plan) == [str(-(-n // 100))] * 2
