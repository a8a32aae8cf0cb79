"""Documents as a data source and a sink: `spark.read.format("docx_parts")`, `spark.readStream`, and `df.write.format("uploads")`.

Both reach any file system that pyarrow knows by the path's scheme (local, HDFS, S3, GCS); files of others go through
`sources.documents`, which lets Spark read their bytes.
"""

from __future__ import annotations

import io
import time
import uuid
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from docaudit.sources.documents import ALLOWED, parse_docx

_RUNS = "runs array<struct<bold:boolean,font_name:string,size_pt:double>>"
PARTS = {
    "paragraphs": f"doc_id string, para_num int, text string, style_name string, {_RUNS}, line_spacing double, first_line_indent_cm double",
    "sections": "doc_id string, section_num int, left_mm double, right_mm double, top_mm double, bottom_mm double",
    "files": "doc_id string, size long, error string",
}
_ROWS = {name: schema.removeprefix("doc_id string, ").replace(" array<", ":array<") for name, schema in PARTS.items()}
#: Paragraphs and sections together, a row a file, for those who need both: a file is opened and parsed once.
PARTS["documents"] = "doc_id string, " + ", ".join(f"{name} array<struct<{', '.join(f if ':array' in f else f.replace(' ', ':', 1) for f in _ROWS[name].split(', '))}>>" for name in ("paragraphs", "sections"))
#: Bytes of files that a task reads, and rows of a batch.
BYTES_PER_TASK, ROWS_PER_BATCH, FILES_PER_BATCH = 1 << 24, 1 << 12, 1 << 6


def at(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class Files(InputPartition):
    """Files that one task reads: (path, size) each."""

    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


def dealt(files: list[pafs.FileInfo]) -> list[InputPartition]:
    """Files in tasks of about BYTES_PER_TASK; a large file stands alone."""
    out, now, total = [], [], 0
    for f in files:
        if now and total + f.size > BYTES_PER_TASK:
            out.append(Files(now))
            now, total = [], 0
        now.append((f.path, f.size))
        total += f.size + 4096
    return [*out, Files(now)] if now else out


class Indexed(InputPartition):
    """Files that one task reads, as row groups of indexes of uploads: (index, row groups) each. The driver holds no file's name."""

    def __init__(self, groups: list[tuple[str, list[int]]]):
        self.groups = groups


def dealt_index(fs: pafs.FileSystem, root: str) -> list[InputPartition]:
    """The row groups of all indexes in tasks of about BYTES_PER_TASK; sizes are taken for the greatest of their group. Only footers are read."""
    out, now, total = [], [], 0
    for f in sorted(fs.get_file_info(pafs.FileSelector(f"{root.rstrip('/')}/index", recursive=True, allow_not_found=True)), key=lambda f: f.path):
        if not f.is_file or not f.path.endswith(".parquet"):
            continue
        with fs.open_input_file(f.path) as opened:
            meta = pq.read_metadata(opened)
        sizes = meta.schema.names.index("size")
        for i in range(meta.num_row_groups):
            group = meta.row_group(i)
            said = group.column(sizes).statistics
            cost = group.num_rows * (4096 + (said.max if said is not None and said.has_min_max else BYTES_PER_TASK))
            if now and total + cost > BYTES_PER_TASK:
                out.append(Indexed(now))
                now, total = [], 0
            if now and now[-1][0] == f.path:
                now[-1][1].append(i)
            else:
                now.append((f.path, [i]))
            total += cost
    return [*out, Indexed(now)] if now else out


class Parts:
    """Rows of one kind of part of DOCX files, with the columns that a schema names and no others."""

    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema, self.path, self.part = schema, options.get("path", ""), options.get("part", "paragraphs")
        self.strict = options.get("mode", "permissive").lower() == "failfast"
        self.only: str | None = None

    def listed(self) -> list[pafs.FileInfo]:
        fs, path = at(self.path)
        found = fs.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True))
        return sorted((f for f in found if f.is_file and f.path.lower().endswith(".docx")), key=lambda f: f.path)

    def rows_of(self, content: bytes, path: str, size: int) -> list[dict]:
        """A file's rows. A file that cannot be read is an error in `files` and has no other parts; an error of the task if mode is failfast."""
        try:
            parsed, error = parse_docx(content), None
        except Exception as e:
            if self.strict:
                raise
            parsed, error = {"paragraphs": [], "sections": []}, str(e) or type(e).__name__
        if self.part == "documents":
            rows = [parsed] if error is None else []
        else:
            rows = [{"size": size, "error": error}] if self.part == "files" else parsed[self.part]
        return [{"doc_id": path, **row} for row in rows]

    def files_of(self, fs: pafs.FileSystem, partition: Files | Indexed | None) -> Iterator[tuple[str, int]]:
        if not isinstance(partition, Indexed):
            yield from partition.files if partition else []  # no partitions come as one without a value
            return
        for index, groups in partition.groups:
            with fs.open_input_file(index) as opened:
                for batch in pq.ParquetFile(opened).iter_batches(ROWS_PER_BATCH, row_groups=groups, columns=["path", "size"]):
                    for path, size in zip(*(batch.column(c).to_pylist() for c in ("path", "size")), strict=True):
                        if path and path.lower().endswith(".docx") and self.only in (None, path):
                            yield path, size

    def batches(self, partition: Files | Indexed | None) -> Iterator[pa.RecordBatch]:
        fs, _ = at(self.path)
        schema, rows, most = to_arrow_schema(self.schema), [], FILES_PER_BATCH if self.part == "documents" else ROWS_PER_BATCH
        for path, size in self.files_of(fs, partition):
            with fs.open_input_stream(path) as f:
                rows += self.rows_of(f.read(), path, size)
            while len(rows) >= most:
                yield self._batch(rows[:most], schema)
                rows = rows[most:]
        if rows:
            yield self._batch(rows, schema)

    @staticmethod
    def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


class DocxReader(Parts, DataSourceReader):
    """All files under the path, listed by the driver, or with option index those that the indexes of uploads in the path name, which the
    tasks read. A filter on doc_id leaves the other files unopened."""

    def __init__(self, schema: T.StructType, options: dict[str, str]):
        Parts.__init__(self, schema, options)
        self.indexed = options.get("index", "false").lower() == "true"

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("doc_id",) and self.only is None:
                self.only = f.value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        if self.indexed:
            return dealt_index(*at(self.path))
        return dealt([f for f in self.listed() if self.only is None or f.path == self.only])

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.batches(partition)


class DocxStreamReader(Parts, DataSourceStreamReader):
    """Files as they come, told by their time of change and path. A file is taken once it has been still for `settle` seconds, so that
    one that lands in the same instant as another is not missed; files that are changed later come again."""

    def __init__(self, schema: T.StructType, options: dict[str, str]):
        Parts.__init__(self, schema, options)
        self.settle = float(options.get("settle", "1"))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"time": -1, "path": ""}

    def _still(self) -> list[pafs.FileInfo]:
        latest = (time.time() - self.settle) * 1e9
        return sorted((f for f in self.listed() if f.mtime_ns <= latest), key=lambda f: (f.mtime_ns, f.path))

    def latestOffset(self) -> dict:  # noqa: N802
        found = self._still()
        return {"time": found[-1].mtime_ns, "path": found[-1].path} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low, high = (start["time"], start["path"]), (end["time"], end["path"])
        return dealt([f for f in self._still() if low < (f.mtime_ns, f.path) <= high])

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.batches(partition)

    def commit(self, end: dict) -> None:
        pass


class DocxParts(DataSource):
    """Parts of DOCX files: option part is paragraphs, sections, files or documents (the first two, as arrays); with option
    index the path is one that uploads went to, and the files are those of its index. `schema` may name fewer columns than there are."""

    @classmethod
    def name(cls) -> str:
        return "docx_parts"

    def schema(self) -> str:
        return PARTS[self.options.get("part", "paragraphs")]

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return DocxReader(schema, self.options)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:  # noqa: N802
        return DocxStreamReader(schema, self.options)


# Uploads

INDEX = pa.schema([("key", pa.int64()), ("name", pa.string()), ("saved_name", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("error", pa.string())])
REFUSED = f"Недопустимый тип файла. Разрешены: {', '.join(ALLOWED)}"


class Landed(WriterCommitMessage):
    def __init__(self, index: str):
        self.index = index


class UploadWriter(DataSourceArrowWriter):
    """Rows (key, name, content) as files and an index.

    A job's files lie in a folder of their own, under names that do not meet; each task writes the index of its files, in row groups of
    about BYTES_PER_TASK of files, which are what readers of the index deal out. The job ends with
    the rename of the folder of indexes: before it nobody who reads the index sees any of the files, after it all. A task that
    fails takes its files with it, and a job that fails its folders: the driver makes them and, on failure, moves them away before they
    are deleted, so that tasks which are still running find no place to write to.
    """

    def __init__(self, options: dict[str, str]):
        self.path, self.job = options["path"].rstrip("/"), uuid.uuid4().hex
        fs, root = at(self.path)
        for d in ("files", "_staged"):
            fs.create_dir(f"{root}/{d}/{self.job}", recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = at(self.path)
        folder, index = f"{root}/files/{self.job}", f"{root}/_staged/{self.job}/{uuid.uuid4().hex}.parquet"
        written, rows, total = [], [], 0
        try:
            with fs.open_output_stream(index) as out, pq.ParquetWriter(out, INDEX) as indexed:
                for batch in iterator:
                    for key, name, content in zip(*(batch.column(c) for c in ("key", "name", "content")), strict=True):
                        name, data = name.as_py() or "", content.as_py() or b""
                        if rows and total + len(data) > BYTES_PER_TASK:
                            indexed.write_table(pa.Table.from_pylist(rows, INDEX))
                            rows, total = [], 0
                        total += len(data) + 4096
                        stem, dot, kind = name.rpartition(".")
                        row = {"key": key.as_py(), "name": name, "saved_name": None, "path": None, "size": len(data), "error": None}
                        if f"{dot}{kind}".lower() not in ALLOWED:
                            rows.append(row | {"error": REFUSED})
                            continue
                        saved = f"{int(time.time())}_{uuid.uuid4().hex[:8]}_{name.replace('/', '_')}"
                        written.append(f"{folder}/{saved}")
                        with fs.open_output_stream(written[-1]) as f:
                            f.write(data)
                        rows.append(row | {"saved_name": saved, "path": written[-1]})
                if rows:
                    indexed.write_table(pa.Table.from_pylist(rows, INDEX))
        except BaseException:
            for path in [*written, index]:
                if fs.get_file_info(path).is_file:
                    fs.delete_file(path)
            raise
        return Landed(index)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = at(self.path)
        staged, kept = f"{root}/_staged/{self.job}", {m.index for m in messages if m is not None}
        if not kept:
            return
        for f in fs.get_file_info(pafs.FileSelector(staged)):
            if f.path not in kept:  # of a task that was run twice
                fs.delete_file(f.path)
        fs.create_dir(f"{root}/index", recursive=True)
        fs.move(staged, f"{root}/index/job={self.job}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = at(self.path)
        for d in ("files", "_staged"):
            if fs.get_file_info(f"{root}/{d}/{self.job}").type != pafs.FileType.NotFound:
                fs.move(f"{root}/{d}/{self.job}", gone := f"{root}/_staged/{self.job}-{d}")
                fs.delete_dir(gone)


class Uploads(DataSource):
    """A sink for files: `df.write.format("uploads").mode("append").save(path)` of (key, name, content)."""

    @classmethod
    def name(cls) -> str:
        return "uploads"

    def schema(self) -> str:
        return "key long, name string, content binary"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("uploads are appended")
        return UploadWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (DocxParts, Uploads):
        spark.dataSource.register(source)


def upload_index(spark: SparkSession, path: str):
    """(key, name, saved_name, path, size, error) of all uploads whose job has ended; a refused file has an error and no path."""
    return spark.read.schema("key long, name string, saved_name string, path string, size long, error string").parquet(f"{path.rstrip('/')}/index/*")


# DOCX bytes

_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_FORBIDDEN = dict.fromkeys([*range(0x09), 0x0B, 0x0C, *range(0x0E, 0x20), 0xFFFE, 0xFFFF])


def _run(text: str, run: dict) -> str:
    bold = "" if run["bold"] is None else f'<w:b w:val="{int(run["bold"])}"/>'
    font = f"<w:rFonts w:ascii={quoteattr(run['font_name'])}/>" if run["font_name"] else ""
    size = f'<w:sz w:val="{round(2 * run["size_pt"])}"/>' if run["size_pt"] else ""
    return f'<w:r><w:rPr>{font}{bold}{size}</w:rPr><w:t xml:space="preserve">{escape(text.translate(_FORBIDDEN))}</w:t></w:r>'


def docx_bytes(paragraphs: list[dict], sections: list[dict]) -> bytes:
    """A DOCX file of paragraphs and sections as parse_docx gives them. A paragraph's text stands in its first run; characters that XML
    has no place for are left out; lengths are rounded to twentieths of a point."""
    body = []
    for p in paragraphs:
        spacing = f'<w:spacing w:line="{round(p["line_spacing"] * 240)}" w:lineRule="auto"/>' if p["line_spacing"] else ""
        twips = round((p["first_line_indent_cm"] or 0) * 360000 / 635)
        indent = f'<w:ind w:{"firstLine" if twips > 0 else "hanging"}="{abs(twips)}"/>' if twips else ""
        style = f"<w:pStyle w:val={quoteattr(p['style_name'].replace(' ', ''))}/>" if p["style_name"] != "Normal" else ""
        runs = p["runs"] or [{"bold": None, "font_name": None, "size_pt": None}]
        body.append(f"<w:p><w:pPr>{style}{spacing}{indent}</w:pPr>{''.join(_run(p['text'] if i == 0 else '', r) for i, r in enumerate(runs))}</w:p>")
    margins = lambda s: "".join(f' w:{side}="{round(s[f"{side}_mm"] * 36000 / 635)}"' for side in ("left", "right", "top", "bottom") if s[f"{side}_mm"] is not None)
    ends = [f"<w:sectPr><w:pgMar{margins(s)}/></w:sectPr>" for s in sections]
    breaks = "".join(f"<w:p><w:pPr>{e}</w:pPr></w:p>" for e in ends[:-1])
    document = f'<?xml version="1.0" encoding="UTF-8"?><w:document {_W}><w:body>{"".join(body)}{breaks}{"".join(ends[-1:])}</w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("word/document.xml", document)
    return out.getvalue()
