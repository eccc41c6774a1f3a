"""Datasets, sharding, office files, sinks and the document stream."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from specweave.operators import render
from specweave.sources import datasets as d
from specweave.sources import sinks
from specweave.sources.office import docx_text, read_docx, read_xlsx
from specweave.streaming.ingest import document_stream, segment_stream

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def docx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def p(text, style=""):
    mark = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{mark}<w:r><w:t>{text}</w:t></w:r></w:p>"


def test_dataset(spark, tmp_path):
    good = tmp_path / "good.json"
    good.write_text("﻿" + json.dumps([{"system_id": "S", "document_id": 1, "text": "a\nb", "more": 1}, {"system_id": "T", "document_id": "x", "text": ""}]), encoding="utf-8")
    assert [tuple(r) for r in d.read_dataset(spark, str(good)).orderBy("pos").collect()] == [("S", "1", "a\nb", 0), ("T", "x", "", 1)]
    for bad, told in (({"a": 1}, "array"), ([1], "item 1: not an object"), ([{"system_id": "S", "document_id": "1", "text": "x"}, {"system_id": "S"}], "item 2: missing document_id, text")):
        f = tmp_path / "bad.json"
        f.write_text(json.dumps(bad))
        with pytest.raises(ValueError, match=told):
            d.read_dataset(spark, str(f))


def test_shards_cover_each_document_once(spark):
    docs = spark.range(10).withColumnRenamed("id", "pos")
    parts = [sorted(r["pos"] for r in d.shard(docs, f"{i}/3").collect()) for i in range(3)]
    assert sorted(sum(parts, [])) == list(range(10)) and len(parts[0]) == 4
    for bad in ("abc", "4/4", "1/0", "-1/2", "1"):
        with pytest.raises(ValueError):
            d.parse_shard(bad)


def test_all_known_errors_count(spark):
    for n in (12_000, 60_000):  # broadcast, and joined by shuffle
        ids = spark.range(n).select(F.col("id").cast("string").alias("document_id"))
        counted, audit, known = ids.withColumn("n", F.lit(7)), ids.withColumn("fr_count", F.lit(6)), ids.withColumn("fr_count", F.lit(7))
        assert d.compare_counts(counted, audit, known).where("status = 'known_error'").count() == n


def test_docx(spark, tmp_path):
    table = "<w:tbl><w:tr><w:tc>" + p("a  b") + "</w:tc><w:tc>" + p("c") + "</w:tc></w:tr><w:tr><w:tc>" + p("") + "</w:tc><w:tc>" + p(" ") + "</w:tc></w:tr></w:tbl>"
    body = p("Title") + p("1.1 Login", "Heading2") + p("") + p("") + p(" text ") + table
    assert docx_text(docx(body)) == "Title\n\n1.1 Login\n\ntext\na b | c\n"
    (tmp_path / "corpus/Shop/Document").mkdir(parents=True)
    (tmp_path / "corpus/Shop/Document/one.docx").write_bytes(docx(body))
    (tmp_path / "corpus/Shop/Document/~$one.docx").write_bytes(b"")
    (tmp_path / "corpus/Shop/Document/bad.docx").write_bytes(b"no zip")
    got = {r["document_id"]: r for r in read_docx(spark, str(tmp_path / "corpus")).collect()}
    assert set(got) == {"one", "bad"} and got["one"]["system_id"] == "Shop" and got["one"]["text"].startswith("Title") and got["bad"]["error"]


def test_xlsx_audit(spark, tmp_path):
    sheet = f'<worksheet xmlns="{S}"><sheetData><row><c t="s"><v>0</v></c><c><v>5</v></c></row><row><c t="s"><v>0</v></c><c><v>7</v></c></row><row><c t="inlineStr"><is><t>x</t></is></c><c/></row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{S}"><si><t>Shop.docx</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    rows = read_xlsx(spark, str(tmp_path)).selectExpr("pos", "cells[0] AS name", "cells[1] AS n")
    audit = d.audit_counts(rows, "name", "n")
    assert [tuple(r) for r in audit.collect()] == [("Shop", 7)]
    counted = spark.createDataFrame([("Shop", 7), ("Other", 1)], "document_id string, n int")
    assert {r["document_id"]: r["status"] for r in d.compare_counts(counted, audit).collect()} == {"Shop": "match", "Other": "unrecorded"}


def test_artefacts_and_stream(spark, tmp_path):
    out = spark.createDataFrame([("S", "a", 1, "body\n")], "system_id string, document_id string, run_id int, body string")
    sinks.write_artefacts(out, str(tmp_path / "out"), "_refined.txt")
    assert (tmp_path / "out/S_a_run1_refined.txt").read_text() == "body\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text(json.dumps({"system_id": "S", "document_id": "a", "text": "1.1 a\n1.2 b"}) + "\n")
    q = segment_stream(document_stream(spark, str(tmp_path / "in")), str(tmp_path / "blocks"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "blocks")).count() == 2


def test_constraints_document(spark):
    docs = spark.createDataFrame([("a", "x"), ("b", "y")], "doc string, text string")
    demoted = spark.createDataFrame([("a", 1, "note", "impl", "dependency", "E", ["F1", "F2"])], "doc string, seq int, requirement string, reason string, diagnostic_view string, affected_element string, source_frs array<string>")
    removed = demoted.where("false").select("doc", "seq", "requirement", "reason")
    got = {r["doc"]: r["body"] for r in render.design_constraints(docs, demoted, removed, ["doc"]).collect()}
    assert "DC-001\nStatement: note\nDemoted because: impl\nDiagnostic view: dependency\nAffected element: E\nSource requirements: F1, F2\n" in got["a"]
    assert got["b"].count("(none)") == 2 and "Rejected during refinement    : 0" in got["b"]
