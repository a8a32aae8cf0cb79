"""DOCX and PDF files as paragraphs, sections, pages and glyphs."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.functions.text import suffix

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
EMU_TWIP, EMU_MM, EMU_CM = 635, 36000, 360000
ALLOWED = (".pdf", ".doc", ".docx", ".txt")
_RUN = "array<struct<bold:boolean,font_name:string,size_pt:double>>"
DOCX = f"paragraphs array<struct<para_num:int,text:string,style_name:string,runs:{_RUN},line_spacing:double,first_line_indent_cm:double>>, sections array<struct<section_num:int,left_mm:double,right_mm:double,top_mm:double,bottom_mm:double>>, error string"
PDF = "pages array<struct<page_num:int,text:string,width:double,height:double>>, chars array<struct<page_num:int,char_num:int,text:string,fontname:string,size:double,x0:double,x1:double,y0:double,y1:double>>, error string"


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, kind, content): files of a folder with their format; what is not read here gets an error row later."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("doc_id"), suffix(F.col("path")).alias("kind"), "content")


def accepted(files: DataFrame) -> DataFrame:
    return files.filter(F.col("kind").isin(*ALLOWED))


def unsupported(files: DataFrame) -> DataFrame:
    """(doc_id, error) of files in a format that has no reader."""
    return files.filter(~F.col("kind").isin(".docx", ".pdf")).select("doc_id", F.concat(F.lit("Неподдерживаемый формат файла: "), "kind").alias("error"))


def _value(node, path: str, name: str = "val") -> str | None:
    found = node.find(path) if node is not None else None
    return found.get(f"{W}{name}") if found is not None else None


def _mm(node, name: str) -> float | None:
    twips = node.get(f"{W}{name}") if node is not None else None
    return int(float(twips)) * EMU_TWIP / EMU_MM if twips else None


def parse_docx(content: bytes) -> dict:
    """Paragraphs and sections of a DOCX file. What a run or paragraph does not say itself (it inherits it) is null."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{W}body")
        names = {}
        if "word/styles.xml" in archive.namelist():
            for style in ElementTree.fromstring(archive.read("word/styles.xml")).iter(f"{W}style"):
                names[style.get(f"{W}styleId")] = _value(style, f"{W}name")
    paragraphs = []
    for i, p in enumerate(body.findall(f"{W}p")):
        own = p.find(f"{W}pPr")
        runs = []
        for r in p.findall(f"{W}r"):
            props = r.find(f"{W}rPr")
            bold = props.find(f"{W}b") if props is not None else None
            half = _value(props, f"{W}sz")
            runs.append({"bold": None if bold is None else bold.get(f"{W}val", "1") not in ("0", "false", "off"), "font_name": _value(props, f"{W}rFonts", "ascii"), "size_pt": float(half) / 2 if half else None})
        text = "".join({f"{W}t": t.text or "", f"{W}tab": "\t", f"{W}br": "\n"}.get(t.tag, "") for r in p.findall(f"{W}r") for t in r)
        line, rule = _value(own, f"{W}spacing", "line"), _value(own, f"{W}spacing", "lineRule")
        spacing = None if not line else float(line) / 240 if rule in (None, "auto") else float(line) * EMU_TWIP
        first, hanging = _value(own, f"{W}ind", "firstLine"), _value(own, f"{W}ind", "hanging")
        indent = float(first) * EMU_TWIP / EMU_CM if first else -float(hanging) * EMU_TWIP / EMU_CM if hanging else None
        style = _value(own, f"{W}pStyle")
        name = names.get(style, style) if style else "Normal"
        name = f"Heading{name[7:]}" if name and name.lower().startswith("heading") else name
        paragraphs.append({"para_num": i, "text": text, "style_name": name, "runs": runs, "line_spacing": spacing, "first_line_indent_cm": indent})
    sections = []
    for i, s in enumerate(body.iter(f"{W}sectPr")):
        margins = s.find(f"{W}pgMar")
        sections.append({"section_num": i} | {f"{side}_mm": _mm(margins, side) for side in ("left", "right", "top", "bottom")})
    return {"paragraphs": paragraphs, "sections": sections}


def parse_pdf(content: bytes) -> dict:
    """Pages and glyphs of a PDF file, if a reader is installed."""
    try:
        import pdfplumber
    except ImportError as e:
        raise RuntimeError("no PDF reader is installed") from e
    pages, chars = [], []
    with pdfplumber.open(io.BytesIO(content)) as pdf:
        for i, page in enumerate(pdf.pages, 1):
            pages.append({"page_num": i, "text": page.extract_text(), "width": float(page.width), "height": float(page.height)})
            chars += [{"page_num": i, "char_num": j, **{k: c.get(k) for k in ("text", "fontname", "size", "x0", "x1", "y0", "y1")}} for j, c in enumerate(page.chars)]
    return {"pages": pages, "chars": chars}


def _read(files: DataFrame, kind: str, parse: Callable[[bytes], dict], schema: str) -> DataFrame:
    fields = [f.split(" ")[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, content in zip(batch["doc_id"], batch["content"], strict=True):
                try:
                    out.append({"doc_id": doc_id, **dict.fromkeys(fields), **parse(bytes(content))})
                except Exception as e:  # a file that cannot be read becomes an error row
                    out.append({"doc_id": doc_id, **dict.fromkeys(fields), "error": str(e) or type(e).__name__})
            yield pd.DataFrame(out, columns=["doc_id", *fields], dtype=object)

    return files.filter(F.col("kind") == kind).select("doc_id", "content").mapInPandas(run, f"doc_id string, {schema}")


def read_docx(files: DataFrame) -> DataFrame:
    """(doc_id, paragraphs, sections, error), one row a file."""
    return _read(files, ".docx", parse_docx, DOCX)


def read_pdf(files: DataFrame) -> DataFrame:
    """(doc_id, pages, chars, error), one row a file."""
    return _read(files, ".pdf", parse_pdf, PDF)


def unfolded(read: DataFrame, column: str) -> DataFrame:
    """Rows of an array column of read_docx or read_pdf, failed files left out."""
    return read.filter("error is null").select("doc_id", F.inline(column))
