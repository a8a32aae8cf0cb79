"""DOCX files, error rows, JSON reports and guarded writes."""

import zipfile

import pytest
from pyspark.sql import functions as F

from docaudit.operators import facts as fx
from docaudit.operators import relational as rel
from docaudit.operators import report as rp
from docaudit.sources import documents as src
from docaudit.sources.reports import read_reports, write_reports

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
BODY = f"""<w:document {NS}><w:body>
<w:p><w:pPr><w:pStyle w:val="h1"/></w:pPr><w:r><w:t>Введение</w:t></w:r></w:p>
<w:p><w:pPr><w:spacing w:line="360" w:lineRule="auto"/><w:ind w:firstLine="709"/></w:pPr><w:r><w:rPr><w:rFonts w:ascii="Arial"/><w:sz w:val="28"/></w:rPr><w:t>Цель работы</w:t></w:r><w:r><w:rPr><w:b w:val="0"/></w:rPr><w:t> и задачи</w:t></w:r></w:p>
<w:sectPr><w:pgMar w:left="1417" w:right="850" w:top="1134" w:bottom="1134"/></w:sectPr></w:body></w:document>"""
STYLES = f'<w:styles {NS}><w:style w:styleId="h1"><w:name w:val="heading 1"/></w:style></w:styles>'


@pytest.fixture
def folder(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", BODY)
        z.writestr("word/styles.xml", STYLES)
    (tmp_path / "b.docx").write_bytes(b"no archive")
    (tmp_path / "c.txt").write_text("x")
    (tmp_path / "d.pdf").write_bytes(b"%PDF-")
    return str(tmp_path)


def test_docx(spark, folder):
    files = src.scan_files(spark, folder)
    assert src.accepted(files).count() == 4
    read = src.read_docx(files)
    facts = fx.paragraph_facts(src.unfolded(read, "paragraphs"), src.unfolded(read, "sections")).collect()
    assert len(facts) == 1
    got = facts[0]
    assert got.required_elements == ["введение"] and got.introduction_text == "Введение Цель работы и задачи"
    assert tuple(got.font_settings) == ("Arial", 14, 1.5) and got.paragraph_indent == 1.25
    assert tuple(got.page_margins) == (25.0, 15.0, 20.0, 20.0)
    errors = read.filter("error is not null").select("doc_id", "error").unionByName(src.unsupported(files))
    rows = rp.error_results(errors).collect()
    assert len(rows) == 2 and all(r.severity == "critical" and not r.is_passed for r in rows)
    assert src.read_pdf(files).filter("error is not null").count() == 1


def test_reports_as_json(spark, tmp_path):
    rows = spark.createDataFrame([("a", 5, 2, None)], "document_id string, total_checks int, passed_checks int, filename string")
    write_reports(rows, str(tmp_path / "r"))
    got = read_reports(spark, str(tmp_path / "r")).first()
    assert (got.document_id, got.total_checks, got.filename, got.results) == ("a", 5, None, None)


def test_lookups(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", "1"), (3, "b", None)], "id int, name string, version string")
    assert rel.one(rel.lookup(df, name="a", version=None)).id == 1
    with pytest.raises(rel.NotFoundError):
        rel.one(rel.lookup(df, name="c"))
    with pytest.raises(rel.TooManyRowsError):
        rel.one(rel.lookup(df, name="a"))


def test_guarded_writes(spark):
    old = spark.createDataFrame([(1, None), (2, "x")], "k int, v string")
    new = spark.createDataFrame([(1, None), (3, "y"), (3, "y"), (2, "z")], "k int, v string")
    assert sorted(map(tuple, rel.insertable(new, old, ["k", "v"]).collect())) == [(2, "z"), (3, "y")]
    assert rel.rejected(new, old, ["k", "v"]).count() == 1
    assert rel.append_unique(old, new, ["k", "v"], bypass=F.col("v").isNull()).count() == 5
    change = spark.createDataFrame([(2, None, ["v"])], "k int, v string, set_columns array<string>")
    assert sorted(map(tuple, rel.update_sparse(old, change, "k", ["v"]).collect())) == [(1, None), (2, None)]
    assert rel.update_sparse(old, change.withColumn("set_columns", F.array().cast("array<string>")), "k", ["v"]).filter("v = 'x'").count() == 1


def test_children_are_empty_not_null(spark):
    parents, children = spark.range(2).withColumnRenamed("id", "k"), spark.createDataFrame([(0, 2, "b"), (0, 1, "a")], "k long, n int, x string")
    got = {r.k: [tuple(c) for c in r.c] for r in rel.with_children(parents, children, "k", "n", ["x"], "c").collect()}
    assert got == {0: [(1, "a"), (2, "b")], 1: []}
