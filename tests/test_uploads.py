"""The upload sink and the DOCX source: round trips, planted failures, chosen columns, streams."""

import os
import pickle
import time

import pytest
from pyspark.sql import functions as F

from docaudit.plans import flows
from docaudit.sources import docx_source
from docaudit.sources.documents import parse_docx

RUN = {"bold": None, "font_name": "Arial", "size_pt": 14.0}
PARAGRAPHS = [
    {"para_num": 0, "text": 'a <b> & "é"\t x', "style_name": "Heading 1", "runs": [RUN | {"bold": True}, RUN | {"size_pt": None}], "line_spacing": 1.5, "first_line_indent_cm": 1.25},
    {"para_num": 1, "text": "", "style_name": "Normal", "runs": [], "line_spacing": None, "first_line_indent_cm": -1.0},
]
SECTIONS = [{"section_num": i, "left_mm": 30.0, "right_mm": None, "top_mm": 20.0 + i, "bottom_mm": 0.0} for i in range(2)]


@pytest.fixture(scope="module")
def session(spark):
    docx_source.register(spark)
    return spark


def files(session, rows):
    return session.createDataFrame(rows, "key long, name string, content binary")


def left(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names if not f.endswith(".crc"))


def test_bytes_hold_what_they_are_made_of():
    got = parse_docx(docx_source.docx_bytes(PARAGRAPHS, SECTIONS))
    first, second = got["paragraphs"][:2]
    assert (first["text"], first["style_name"], first["runs"], first["line_spacing"]) == (PARAGRAPHS[0]["text"], "Heading1", PARAGRAPHS[0]["runs"], 1.5)
    assert abs(first["first_line_indent_cm"] - 1.25) < 0.002 and abs(second["first_line_indent_cm"] + 1) < 0.002 and second["text"] == ""
    assert [(s["section_num"], s["right_mm"], round(s["top_mm"], 1), s["bottom_mm"]) for s in got["sections"]] == [(0, None, 20.0, 0.0), (1, None, 21.0, 0.0)]
    assert parse_docx(docx_source.docx_bytes([PARAGRAPHS[0] | {"text": "a\x00\x0bb"}], SECTIONS))["paragraphs"][0]["text"] == "ab"


def test_uploads_land_with_their_index(session, tmp_path):
    path = f"file://{tmp_path}/u"
    rows = [(1, "a.docx", b"x"), (2, "B.PDF", b""), (3, "c.exe", b"y"), (4, None, b"z"), (5, "a/b.txt", None), (1, "a.docx", b"x"), (None, "d.doc", b"w")]
    for _ in range(2):
        files(session, rows).repartition(3).write.format("uploads").mode("append").save(path)
    got = docx_source.upload_index(session, path).collect()
    assert len(got) == 14 and sum(r.error is None for r in got) == 10 == len(left(f"{tmp_path}/u/files")) == len({r.path for r in got if r.path})
    assert {(r.key, r.name) for r in got if r.error} == {(3, "c.exe"), (4, "")} and all((r.path is None) == (r.error is not None) for r in got)
    for r in got:
        if r.path:
            assert os.path.getsize(r.path) == r.size and r.path.endswith(r.saved_name)
    assert not left(f"{tmp_path}/u/_staged")


def test_a_failed_job_leaves_no_file_and_no_row(session, tmp_path):
    path = f"file://{tmp_path}/u"
    files(session, [(0, "kept.txt", b"k")]).write.format("uploads").mode("append").save(path)
    before = left(f"{tmp_path}/u")
    bad = session.range(40).repartition(4).select(F.col("id").alias("key"), F.lit("a.txt").alias("name"), F.when(F.col("id") == 33, F.raise_error(F.lit("planted"))).otherwise("x").cast("binary").alias("content"))
    with pytest.raises(Exception, match="planted"):
        bad.write.format("uploads").mode("append").save(path)
    assert left(f"{tmp_path}/u") == before and docx_source.upload_index(session, path).count() == 1
    with pytest.raises(Exception, match="appended"):
        bad.write.format("uploads").mode("overwrite").save(path)


def test_a_task_that_fails_takes_its_files_with_it(tmp_path):
    writer = docx_source.UploadWriter({"path": f"{tmp_path}/u"})

    def batches():
        yield docx_source.pa.RecordBatch.from_pylist([{"key": 1, "name": "a.txt", "content": b"x"}])
        raise RuntimeError("planted")

    with pytest.raises(RuntimeError):
        writer.write(batches())
    assert left(f"{tmp_path}/u") == []
    twice = [writer.write(iter([docx_source.pa.RecordBatch.from_pylist([{"key": 1, "name": "a.txt", "content": b"x"}])])) for _ in range(2)]
    writer.commit(twice[:1])  # the other attempt's index is not taken
    assert [f for f in left(f"{tmp_path}/u") if f.startswith("index")] == [f"index/job={writer.job}/{os.path.basename(twice[0].index)}"]


@pytest.fixture
def folder(tmp_path):
    for i in range(5):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / f"in/{i}.docx").write_bytes(docx_source.docx_bytes(PARAGRAPHS * (i + 1), SECTIONS))
    (tmp_path / "in/broken.docx").write_bytes(b"no zip")
    (tmp_path / "in/other.txt").write_bytes(b"x")
    return tmp_path


def read(session, folder, part, **options):
    return session.read.format("docx_parts").option("part", part).options(**options).load(f"file://{folder}/in")


def test_parts_of_files(session, folder):
    # every section but the last ends in a paragraph of its own
    assert read(session, folder, "paragraphs").count() == 2 * 15 + 5 and read(session, folder, "sections").count() == 10
    errors = {os.path.basename(r.doc_id): r.error for r in read(session, folder, "files").collect()}
    assert len(errors) == 6 and errors["broken.docx"] and not errors["0.docx"]
    with pytest.raises(Exception, match="zip"):
        read(session, folder, "paragraphs", mode="failfast").count()
    assert session.read.format("docx_parts").load(f"file://{folder}/none").count() == 0


def test_columns_and_files_are_chosen(session, folder):
    few = session.read.format("docx_parts").schema("text string, para_num int").load(f"file://{folder}/in")
    assert few.columns == ["text", "para_num"] and few.filter("para_num = 0").first().text == PARAGRAPHS[0]["text"]
    one = read(session, folder, "sections", mode="failfast").filter(F.col("doc_id") == f"{folder}/in/2.docx")
    assert one.count() == 2  # the broken file would fail: it is not opened


def test_small_tasks_and_batches(session, folder, monkeypatch):
    monkeypatch.setattr(docx_source, "BYTES_PER_TASK", 1)
    monkeypatch.setattr(docx_source, "ROWS_PER_BATCH", 3)
    reader = docx_source.DocxReader(docx_source.T._parse_datatype_string(docx_source.PARTS["paragraphs"]), {"path": str(folder / "in")})
    parts = reader.partitions()
    assert len(parts) == 6 and sum(b.num_rows for p in parts for b in reader.read(p)) == 35 and max(b.num_rows for p in parts for b in reader.read(p)) == 3


def test_a_stream_of_files_goes_on_after_a_restart(session, folder):
    def go():
        stream = session.readStream.format("docx_parts").option("part", "sections").option("settle", "0").load(f"file://{folder}/in")
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
        return session.read.schema(stream.schema).parquet(f"{folder}/out").count()

    assert go() == 10 and go() == 10
    time.sleep(0.05)
    (folder / "in/late.docx").write_bytes(docx_source.docx_bytes(PARAGRAPHS, SECTIONS))
    assert go() == 12


def test_paragraphs_and_sections_come_from_one_pass_over_the_files(spark, tmp_path):
    docx_source.register(spark)
    run = {"bold": True, "font_name": "Arial", "size_pt": 12.0}
    for name, n in (("a", 3), ("b", 0), ("c", 70)):
        rows = [{"text": f"{name} {i}", "style_name": "Normal", "runs": [run], "line_spacing": 1.5, "first_line_indent_cm": None} for i in range(n)]
        (tmp_path / f"{name}.docx").write_bytes(docx_source.docx_bytes(rows, [{f"{side}_mm": 20.0 for side in ("left", "right", "top", "bottom")}]))
    (tmp_path / "broken.docx").write_bytes(b"no archive")
    read = lambda part: spark.read.format("docx_parts").option("part", part).load(str(tmp_path))
    both = read("documents")
    assert both.count() == 3
    for part in ("paragraphs", "sections"):
        own = read(part)
        unfolded = both.selectExpr("doc_id", f"inline({part})").select(own.columns)
        assert unfolded.dtypes == own.dtypes and sorted(map(str, unfolded.collect())) == sorted(map(str, own.collect()))


def test_facts_of_uploads_parse_each_file_once(spark):
    """The facts are computed from a table, not from the files again."""
    plan = flows.docx_facts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "docx_parts" not in plan and "BatchScan" not in plan


def test_the_driver_names_no_file_of_an_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(docx_source, "BYTES_PER_TASK", 60_000)
    docx = docx_source.docx_bytes(PARAGRAPHS, SECTIONS)
    rows = [{"key": i, "name": f"{i}.docx" if i % 9 else f"{i}.{('exe', 'txt')[i % 2]}", "content": docx} for i in range(200)]
    writer = docx_source.UploadWriter({"path": f"{tmp_path}/u"})
    writer.commit([writer.write(iter([docx_source.pa.RecordBatch.from_pylist(part)])) for part in (rows[:150], rows[150:195], rows[195:])])
    unseen = docx_source.UploadWriter({"path": f"{tmp_path}/u"})
    unseen.write(iter([docx_source.pa.RecordBatch.from_pylist([{"key": 7, "name": "7.docx", "content": docx}])]))  # a job that has not ended
    reader = docx_source.DocxReader(docx_source.T._parse_datatype_string(docx_source.PARTS["documents"]), {"path": f"{tmp_path}/u", "part": "documents", "index": "true"})
    parts = reader.partitions()
    assert 12 < len(parts) < 40 and b"1.docx" not in pickle.dumps(parts)
    got = sorted(os.path.basename(i).split("_")[-1] for p in parts for b in reader.read(p) for i in b.column("doc_id").to_pylist())
    assert got == sorted(r["name"] for r in rows if r["name"].endswith(".docx")) and max(sum(b.num_rows for b in reader.read(p)) for p in parts) <= 14
    reader.only = next(i for p in parts for b in reader.read(p) for i in b.column("doc_id").to_pylist() if i.endswith("_100.docx"))
    assert [b.column("doc_id").to_pylist() for p in reader.partitions() for b in reader.read(p)] == [[reader.only]]
    assert docx_source.DocxReader(reader.schema, {"path": f"{tmp_path}/none", "part": "documents", "index": "true"}).partitions() == []


def test_facts_of_uploads_go_by_the_index(spark, monkeypatch):
    """A file beside the uploads that no index names is no document: nobody lists the folder."""
    land = flows.uploaded

    def and_a_stray(*args):
        path = land(*args)
        with open(f"{path.removeprefix('file://')}/files/987654.docx", "wb") as f:
            f.write(docx_source.docx_bytes(PARAGRAPHS, SECTIONS))
        return path

    monkeypatch.setattr(flows, "uploaded", and_a_stray)
    got = flows.docx_facts(spark, "/root/testdata/sf0.001").select("doc_id")
    assert sorted(got.collect()) == sorted(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id").collect())


def test_a_task_that_outlives_its_job_leaves_nothing(tmp_path):
    batch = docx_source.pa.RecordBatch.from_pylist([{"key": 1, "name": "a.txt", "content": b"x"}])
    writer = docx_source.UploadWriter({"path": f"{tmp_path}/u"})
    writer.write(iter([batch]))
    writer.abort([])
    with pytest.raises(FileNotFoundError):
        writer.write(iter([batch]))
    assert left(f"{tmp_path}/u") == []
