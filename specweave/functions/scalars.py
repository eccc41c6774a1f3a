"""Scalar column functions: identifiers, trimming, coercion of untyped JSON, decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vocabularies of the data model.
ELEMENT_TYPES = ("FUNCTION", "DATA", "ACTOR", "STATE", "EVENT", "CONSTRAINT")
RELATION_TYPES = ("ENABLES", "TRIGGERS", "PREVENTS", "MODIFIES", "CONTROLS", "PRODUCES", "DEPENDS_ON")
DECISIONS = ("YES", "NO", "UNCERTAIN")
ISOLATION_LABELS = ("GENUINE_GAP", "IMPLICIT_DEPENDENCY")

#: All white space of Unicode and the four separators of ASCII.
WHITE_SPACE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends (trim() takes spaces only)."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def stable_id(prefix: str, *values: Column) -> Column:
    """prefix and 16 hex digits of the SHA-256 of the values joined by ``||``; null counts as ``None``."""
    text = F.concat_ws("||", *(F.coalesce(v.cast("string"), F.lit("None")) for v in values))
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(text, 256), 1, 16))


def variant_kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0)


def coerce_float(v: Column, default: float = 0.0) -> Column:
    """Number of a VARIANT: numbers, and strings that are numbers; booleans and all else give the default."""
    kind, text = variant_kind(v), F.try_variant_get(v, "$", "string")
    number = F.when(kind.isin("BIGINT", "DOUBLE", "DECIMAL", "FLOAT"), F.try_variant_get(v, "$", "double"))
    parsed = F.when((kind == "STRING") & strip(text).rlike(_NUMBER), strip(text).try_cast("double"))
    return F.coalesce(number, parsed, F.lit(float(default)))


def to_confidence(score: Column) -> Column:
    """Unit interval: negative or above 100 (and NaN) is 0, above 1 is a percentage."""
    bad = score.isNull() | F.isnan(score) | (score < 0) | (score > 100)
    return F.when(bad, 0.0).when(score > 1, score / 100).otherwise(score)


def coerce_confidence(v: Column) -> Column:
    return to_confidence(coerce_float(v, -1.0))


def coerce_str(v: Column, default: str = "") -> Column:
    """Stripped text of a VARIANT; null (and JSON null) gives the default."""
    return F.coalesce(strip(F.try_variant_get(v, "$", "string")), F.lit(default))


def coerce_str_list(v: Column) -> Column:
    """Texts of a VARIANT list; a lone string wraps, other kinds are empty, null and blank entries go."""
    items = F.coalesce(F.when(variant_kind(v) == "STRING", F.array(F.try_variant_get(v, "$", "string"))), F.try_variant_get(v, "$", "array<string>"), F.array().cast("array<string>"))
    return F.filter(F.transform(items, strip), lambda x: x.isNotNull() & (x != ""))


def flatten_unique(groups: Column) -> Column:
    """Stripped, non-empty texts of an array of arrays, each at its first place."""
    return F.array_distinct(F.filter(F.transform(F.flatten(groups), strip), lambda x: x.isNotNull() & (x != "")))


def normalize_decision(c: Column) -> Column:
    upper = F.upper(strip(F.coalesce(c, F.lit(""))))
    return F.when(upper.isin(*DECISIONS), upper).otherwise(F.lit("UNCERTAIN"))


def eligible(evidence: Column, coverage: Column, boundary: Column) -> Column:
    """A finding goes on to generation: evidence YES, coverage NO, boundary YES; null decisions do not."""
    return F.coalesce((evidence == "YES") & (coverage == "NO") & (boundary == "YES"), F.lit(False))
