"""Cutting specification texts into numbered requirement blocks, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from specweave.functions.scalars import strip

# The identifier grammar, most specific form first.
FR_ID = r"FR(?:(?:-[A-Z]{1,6})?-\d+|\s+\d+)"
REQUIREMENT_ID = FR_ID + r"|Function Requirement\s+\d+|\d+\.\d+\.\d+|\d+\.\d+|F\d+"
# Line starts that open a block, in the order that breaks ties. Only \n ends a line (flag d).
SPLITS = (
    r"(?Udmi)(?=^#{0,6}\s*(?:" + FR_ID + "))",
    r"(?Udm)(?=^Function Requirement\s+\d+)",
    r"(?Udm)(?=^F\d+\s)",
    r"(?Udm)(?=^\d+\.\d+\.\d+\s)",
    r"(?Udm)(?=^#{1,6}\s+\d+\.\d+\s)",
    r"(?Udm)(?=^\d+\.\d+\s)",
)
_MARKER = rf"(?Ui)({REQUIREMENT_ID})"
_HEADING = r"^\d+\.\s+(?!\d)\S"
_SCOPE = rf"(?Udm)^\d+\.\s+(?!\d)(?=\S)(?i:[^\n]*?requirement)[\s\S]*?(?=(?!^)\z|\n{_HEADING})"
_FIRST_LINE = r"^[^\n\r\x0B\x0C\x1C-\x1E\x85  ]*"


def requirements_scope(text: Column) -> Column:
    """From the first top-level heading that names requirements to the next top-level heading; else the text."""
    body = strip(F.regexp_extract(text, _SCOPE, 0))
    return F.when(body != "", body).otherwise(text)


def _parts(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(text, pattern), strip), lambda x: x != "")


def _marker(block: Column) -> Column:
    return F.regexp_extract(strip(F.regexp_extract(block, _FIRST_LINE, 0)), _MARKER, 1)


def split_columns(text: Column) -> dict[str, Column]:
    """The six splits of a scoped, stripped text and the split at blank lines, as columns to be computed once each."""
    return {f"_p{i}": _parts(text, p) for i, p in enumerate((*SPLITS, r"\n{2,}"))}


def longest_split() -> Column:
    """Of the columns of split_columns: most parts, at least two, the first pattern on ties; else blank lines."""
    n = [F.size(f"_p{i}") for i in range(len(SPLITS))]
    most = F.greatest(*n)
    chosen = F.col(f"_p{len(SPLITS)}")
    for i in reversed(range(len(SPLITS))):
        chosen = F.when((n[i] == most) & (most >= 2), F.col(f"_p{i}")).otherwise(chosen)
    return chosen


def marked(parts: Column) -> Column:
    """array<struct<id, block>>; id is empty where a block's first line has no identifier."""
    return F.transform(parts, lambda p: F.struct(_marker(p).alias("id"), p.alias("block")))


def numbered(blocks: Column) -> Column:
    """array<struct<seq, requirement_id, block>> of marked blocks, preamble dropped, BLOCK-n where none is marked."""
    return F.transform(_without_preamble(blocks), lambda m, i: F.struct(i.alias("seq"), F.when(m["id"] != "", m["id"]).otherwise(F.concat(F.lit("BLOCK-"), (i + 1).cast("string"))).alias("requirement_id"), m["block"].alias("block")))


def _without_preamble(blocks: Column) -> Column:
    rest = F.slice(blocks, 2, F.greatest(F.size(blocks), F.lit(1)))
    drop = (F.size(blocks) >= 2) & (F.try_element_at(blocks, F.lit(1))["id"] == "") & F.exists(rest, lambda m: m["id"] != "")
    return F.when(drop, rest).otherwise(blocks)
