"""Segmentation and numbering goldens: text -> identifiers, dialect, next numbers."""

import pytest
from pyspark.sql import functions as F

from specweave.operators.numbering import assign_numbers, numbering_context
from specweave.operators.segments import blocks, context

# text, identifiers, (dialect, major, last), next two numbers
CASES = {
    "dot": ("1.1 Login\nuser logs in\n1.2 Logout", ["1.1", "1.2"], ("dot", "1", 2), ["1.3", "1.4"]),
    "mddot": ("## 1.1 Login\nx\n## 1.2 Logout", ["1.1", "1.2"], ("mddot", "1", 2), ["1.3", "1.4"]),
    "dash": ("FR-001 Login\nFR-002 Logout", ["FR-001", "FR-002"], ("dash", "", 2), ["FR-003", "FR-004"]),
    "heading dash": ("### FR-01 Login\nx\n### FR-02 Out", ["FR-01", "FR-02"], ("dash", "", 2), ["FR-003", "FR-004"]),
    "word": ("Function Requirement 1: a\nFunction Requirement 2: b", ["Function Requirement 1", "Function Requirement 2"], ("word", "", 2), ["Function Requirement 3", "Function Requirement 4"]),
    "letter": ("F1 Login\nF2 Logout", ["F1", "F2"], ("letter", "", 2), ["F3", "F4"]),
    "space": ("FR 1: a\nFR 2: b", ["FR 1", "FR 2"], ("space", "", 2), ["FR 3:", "FR 4:"]),
    "dot3": ("The system\n3.1.1 x\n3.1.2 y", ["3.1.1", "3.1.2"], ("dot3", "3.1", 2), ["3.1.3", "3.1.4"]),
    "compound": ("FR-DCI-001 a\nFR-DCI-002 b", ["FR-DCI-001", "FR-DCI-002"], ("compound", "", 2), ["FR-DCI-003", "FR-DCI-004"]),
    "sections hold FR": ("Web store\n2.1 One\nFR-001 a\nFR-002 b\n2.2 Two\nFR-003 c\nFR-004 d\nFR-005 e", ["FR-001", "FR-002", "FR-003", "FR-004", "FR-005"], ("dash", "", 5), ["FR-006", "FR-007"]),
    "nested": ("The system\n3.1 A\n3.1.1 a\n3.1.2 b\n3.2 B\n3.2.1 c\n3.2.2 d", ["3.1.1", "3.1.2", "3.2.1", "3.2.2"], ("dot3", "3.1", 2), ["3.1.3", "3.1.4"]),
    "scope": ("1. Introduction\nabc\n2. Functional Requirements\n2.1 a\n2.2 b\n3. External Interfaces\n3.1 c\n3.2 d", ["2.1", "2.2"], ("dot", "2", 2), ["2.3", "2.4"]),
    "preamble": ("Requirements of the system\n3.1 a\n3.2 b", ["3.1", "3.2"], ("dot", "3", 2), ["3.3", "3.4"]),
    "prose": ("One thing.\n\nAnother thing.\n\n\nLast thing.", ["BLOCK-1", "BLOCK-2", "BLOCK-3"], ("space", "", 0), ["FR 1:", "FR 2:"]),
    "empty": ("", [], ("space", "", 0), ["FR 1:", "FR 2:"]),
    "null": (None, [], ("space", "", 0), ["FR 1:", "FR 2:"]),
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, v[0]) for k, v in CASES.items()], "doc string, text string").cache()


def test_identifiers(spark, docs):
    got = {}
    for r in blocks(docs, ["doc"]).orderBy("doc", "seq").collect():
        got.setdefault(r["doc"], []).append(r["requirement_id"])
    assert {k: got.get(k, []) for k in CASES} == {k: v[1] for k, v in CASES.items()}


def test_numbering(spark, docs):
    ctx = numbering_context(docs, blocks(docs, ["doc"]), ["doc"])
    rows = {r["doc"]: (r["dialect"], r["major"], r["last"]) for r in ctx.collect()}
    assert rows == {k: v[2] for k, v in CASES.items()}
    more = docs.select("doc", F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"))
    got = {}
    for r in assign_numbers(more, ctx, ["doc"]).orderBy("doc", "seq").collect():
        got.setdefault(r["doc"], []).append(r["fr_number"])
    assert got == {k: v[3] for k, v in CASES.items()}


def test_context(spark, docs):
    asked = spark.createDataFrame([("dot", ["1.2"]), ("dot", []), ("dot", ["9.9"])], "doc string, requirement_ids array<string>")
    got = {tuple(r["requirement_ids"]): r["context"] for r in context(asked, blocks(docs, ["doc"]), docs, ["doc"]).collect()}
    assert got == {("1.2",): "1.2 Logout", (): "1.1 Login\nuser logs in\n\n1.2 Logout", ("9.9",): CASES["dot"][0]}
