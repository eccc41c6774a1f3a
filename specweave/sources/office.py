"""DOCX and XLSX files as tables: zip and XML are read on the executors, one file per row."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specweave.sources.datasets import project_of

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _paragraph(p) -> str:
    out = []
    for node in p.iter():
        if node.tag == f"{_W}t":
            out.append(node.text or "")
        elif node.tag in (f"{_W}tab", f"{_W}br"):
            out.append("\t" if node.tag.endswith("tab") else "\n")
    return "".join(out)


def _table(t) -> str:
    """Rows of cells joined by `` | ``, white space collapsed; rows without text are left out."""
    rows = []
    for tr in t.iter(f"{_W}tr"):
        cells = [re.sub(r"\s+", " ", "\n".join(_paragraph(p) for p in tc.iter(f"{_W}p"))).strip() for tc in tr.iter(f"{_W}tc")]
        if any(cells):
            rows.append(" | ".join(cells))
    return "\n".join(rows)


def docx_text(data: bytes) -> str:
    """Paragraphs and tables in order; a blank line before headings, never two blank lines; one line end at the close."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        styles = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                name = s.find(f"{_W}name")
                styles[s.get(f"{_W}styleId")] = name.get(f"{_W}val") if name is not None else ""
    lines: list[str] = []
    for block in body:
        if block.tag == f"{_W}p":
            text = _paragraph(block).strip()
            style = block.find(f"{_W}pPr/{_W}pStyle")
            name = styles.get(style.get(f"{_W}val"), style.get(f"{_W}val")) if style is not None else ""
            if text and name.lower().startswith("heading") and lines and lines[-1]:
                lines.append("")
        elif block.tag == f"{_W}tbl":
            text = _table(block)
        else:
            continue
        if text or (lines and lines[-1]):
            lines.append(text)
    return "\n".join(lines).strip() + "\n"


def xlsx_rows(data: bytes) -> list[list[str]]:
    """Cell texts of the first worksheet; missing values are empty, absent cells are not padded."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        first = min(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
        rows = []
        for row in ElementTree.fromstring(z.read(first)).iter(f"{_S}row"):
            cells = []
            for c in row.iter(f"{_S}c"):
                value = c.find(f"{_S}v")
                text = (value.text or "") if value is not None else "".join(t.text or "" for t in c.iter(f"{_S}t"))
                cells.append(shared[int(text)] if c.get("t") == "s" and text else text)
            rows.append(cells)
    return rows


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Files below path; lock files and hidden or underscored folders are skipped."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    inside = F.regexp_replace("path", "^.*?" + re.escape(path.rstrip("/").split("/")[-1]) + "/", "")
    return files.where(~name.startswith("~$") & ~inside.rlike(r"(^|/)[._]"))


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """system_id, document_id, text, error of every DOCX below path; a broken file gives an error, no text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                try:
                    rows.append((r.system_id, r.document_id, docx_text(r.content), None))
                except Exception as e:  # whatever a damaged file raises is that file's error
                    rows.append((r.system_id, r.document_id, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["system_id", "document_id", "text", "error"])

    named = _files(spark, path, "*.docx").select(project_of(F.col("path")).alias("system_id"), F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?i)\.docx$", "").alias("document_id"), "content")
    return named.mapInPandas(run, "system_id string, document_id string, text string, error string")


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """file, pos, cells of the first worksheet of every workbook below path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(r.path, i, cells) for r in pdf.itertuples() for i, cells in enumerate(xlsx_rows(r.content))]
            yield pd.DataFrame(rows, columns=["file", "pos", "cells"])

    return _files(spark, path, "*.xlsx").select("path", "content").mapInPandas(run, "file string, pos long, cells array<string>")
