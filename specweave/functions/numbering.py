"""Numbering dialects of requirement identifiers, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How each dialect's identifier looks, in order of test; the flag i only where case is free.
DIALECTS = (
    ("dot3", r"(?U)^\d+\.\d+\.\d+\z"),
    ("dot", r"(?U)^\d+\.\d+\z"),
    ("word", r"(?U)^Function Requirement \d+\z"),
    ("space", r"(?U)^FR\s+\d+\z"),
    ("compound", r"(?Ui)^FR-[A-Z]{1,6}-\d+\z"),
    ("dash", r"(?Ui)^FR-\d+\z"),
    ("letter", r"(?U)^F\d+\z"),
)
# What a text without any identifier is searched for, in order; else the dialect is "space".
TEXT_DIALECTS = (
    ("word", r"(?Udm)^Function Requirement \d+"),
    ("mddot", r"(?Udm)^#{1,3}\s+\d+\.\d+\s"),
    ("dot", r"(?Udm)^\d+\.\d+\s"),
    ("dash", r"(?Udmi)^FR-\d+"),
    ("letter", r"(?Udm)^F\d+"),
)


def _first_match(c: Column, table, otherwise: str | None) -> Column:
    out = F.lit(otherwise).cast("string")
    for name, pattern in reversed(table):
        out = F.when(c.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def classify_id(requirement_id: Column) -> Column:
    """Dialect of an identifier, null if none."""
    return _first_match(requirement_id, DIALECTS, None)


def dialect_of_text(text: Column) -> Column:
    return _first_match(text, TEXT_DIALECTS, "space")


def major_of(requirement_id: Column) -> Column:
    """``3.1`` of ``3.1.1``, ``3`` of ``3.1``, else null."""
    deep, flat = F.regexp_extract(requirement_id, r"(?U)^(\d+\.\d+)\.\d+\z", 1), F.regexp_extract(requirement_id, r"(?U)^(\d+)\.\d+\z", 1)
    return F.when(deep != "", deep).when(flat != "", flat)


def number_of(requirement_id: Column, major: Column) -> Column:
    """Trailing number of an identifier; dotted ones count only within ``major`` (any, if that is empty)."""
    dotted = F.regexp_extract(requirement_id, r"(?U)^(?:\d+\.)?\d+\.(\d+)\z", 1)
    plain = F.regexp_extract(requirement_id, r"(?Ui)^(?:Function Requirement\s+|FR-[A-Z]{1,6}-|FR-|FR\s+|F)(\d+)\z", 1)
    inside = (major == "") | (major_of(requirement_id) == major)
    return F.when(dotted != "", F.when(inside, dotted)).when(plain != "", plain).try_cast("bigint")


def format_number(dialect: Column, major: Column, number: Column, prefix: Column) -> Column:
    """One requirement number in a dialect; numbers are zero-padded to three digits where the dialect pads."""
    n = number.cast("string")
    padded = F.lpad(n, F.greatest(F.length(n), F.lit(3)), F.lit("0"))
    return (
        F.when(dialect.isin("dot", "dot3", "mddot"), F.when(major != "", F.concat(major, F.lit("."), n)).otherwise(n))
        .when(dialect == "word", F.concat(F.lit("Function Requirement "), n))
        .when(dialect == "dash", F.concat(F.lit("FR-"), padded))
        .when(dialect == "compound", F.concat(F.when(prefix != "", prefix).otherwise(F.lit("FR-NEW")), F.lit("-"), padded))
        .when(dialect == "letter", F.concat(F.lit("F"), n))
        .otherwise(F.concat(F.lit("FR "), n, F.lit(":")))
    )
