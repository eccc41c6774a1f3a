"""Findings: review patterns by relation type, filters of the three views, validation, generation requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specweave.functions.scalars import ISOLATION_LABELS, flatten_unique, normalize_decision, stable_id, strip

# What may be missing around a relation of each type.
REVIEW_PATTERNS = {
    "ENABLES": ["MISSING_PRECONDITION", "MISSING_UNAVAILABILITY_RESPONSE", "MISSING_FALLBACK"],
    "DEPENDS_ON": ["MISSING_PRECONDITION", "MISSING_DEPENDENCY_FAILURE_RESPONSE", "MISSING_FALLBACK"],
    "TRIGGERS": ["MISSING_TRIGGERED_RESPONSE", "MISSING_NOTIFICATION"],
    "PREVENTS": ["MISSING_ENFORCEMENT", "MISSING_DENIAL_RESPONSE"],
    "CONTROLS": ["MISSING_AUTHORIZATION", "MISSING_ACCESS_DENIAL", "MISSING_AUDIT"],
    "MODIFIES": ["MISSING_STATE_PROPAGATION", "MISSING_CONSISTENCY_HANDLING", "MISSING_ROLLBACK"],
    "PRODUCES": ["MISSING_CONSUMPTION", "MISSING_STORAGE", "MISSING_VALIDATION", "MISSING_PRODUCTION_FAILURE_HANDLING"],
}


def pattern_table(spark: SparkSession) -> DataFrame:
    """relation_type, pattern: 20 rows."""
    rows = ", ".join(f"('{t}', '{p}')" for t, patterns in REVIEW_PATTERNS.items() for p in patterns)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS v(relation_type, pattern)")


def with_patterns(records: DataFrame, keys: list[str]) -> DataFrame:
    """records (with relation_types) and their sorted distinct patterns; records without any are left out."""
    table = F.broadcast(pattern_table(records.sparkSession))
    found = records.select(*keys, "record_id", F.explode("relation_types").alias("relation_type")).join(table, "relation_type").groupBy(*keys, "record_id").agg(F.array_sort(F.collect_set("pattern")).alias("patterns"))
    return records.join(found, [*keys, "record_id"])


def with_sources(records: DataFrame, elements: DataFrame, keys: list[str]) -> DataFrame:
    """records with the ordered union of both ends' requirement ids."""
    of = lambda side: elements.select(*keys, F.col("name").alias(side), F.col("source_frs").alias(f"_{side}_frs"))
    joined = records.join(of("source"), [*keys, "source"]).join(of("target"), [*keys, "target"])
    return joined.withColumn("record_frs", flatten_unique(F.array("_source_frs", "_target_frs"))).drop("_source_frs", "_target_frs")


def _or(given: Column, fallback: Column) -> Column:
    return F.when(F.size(given) > 0, given).otherwise(fallback)


def dependency_findings(items: DataFrame) -> DataFrame:
    """Findings of nominated items (record columns plus gap_type, item_frs, excerpts, affected, raw_affected, reason)."""
    gap = F.upper(strip(F.col("gap_type")))
    return items.withColumn("gap_type", gap).where(F.array_contains("patterns", F.col("gap_type"))).withColumns({
        "finding_id": stable_id("finding", F.col("record_id"), F.col("gap_type"), F.col("raw_affected")), "view": F.lit("dependency"), "source_frs": _or(F.col("item_frs"), F.col("record_frs")), "supporting_excerpts": F.col("excerpts"),
        "source_element": F.col("source"), "target_element": F.col("target"), "affected_element": F.when(F.coalesce(strip(F.col("affected")), F.lit("")) != "", strip(F.col("affected"))).otherwise(F.col("target")),
        "relation_type": F.array_join("relation_types", "|"), "dependency_path": F.col("path"), "nomination_reason": F.col("reason"),
    })


def isolation_findings(items: DataFrame) -> DataFrame:
    """At most one finding per isolated element (element columns plus label, gap_type, item_frs, excerpts, reason)."""
    gap = F.upper(strip(F.coalesce("gap_type", F.lit(""))))
    gap = F.when(gap == "", "MISSING_INTEGRATION").otherwise(gap)
    kept = items.where(F.upper(strip(F.col("label"))).isin(*ISOLATION_LABELS)).withColumn("gap_type", gap)
    return kept.withColumns({
        "finding_id": stable_id("finding", F.lit("isolation"), F.col("name"), F.col("gap_type")), "view": F.lit("isolation"), "source_frs": _or(F.col("item_frs"), F.col("source_frs")),
        "supporting_excerpts": _or(F.col("excerpts"), F.col("supporting_excerpts")), "affected_element": F.col("name"), "nomination_reason": F.col("reason"),
    })


def operation_findings(items: DataFrame) -> DataFrame:
    """Findings with an affected element and a gap type; neither is checked against a vocabulary."""
    named = items.withColumns({"affected_element": strip(F.col("affected")), "gap_type": F.upper(strip(F.col("gap_type")))}).where("affected_element <> '' AND gap_type <> ''")
    return named.withColumns({"finding_id": stable_id("finding", F.lit("operation"), F.col("affected_element"), F.col("gap_type")), "view": F.lit("operation"), "source_frs": F.col("item_frs"), "supporting_excerpts": F.col("excerpts"), "nomination_reason": F.col("reason")})


def decide(findings: DataFrame, evidence: str | Column, coverage: str | Column, boundary: str | Column, on: tuple[Column, Column, Column]) -> DataFrame:
    """Normalised decisions; a validator that is off counts as YES, NO, YES."""
    raw = {"evidence": (evidence, "YES"), "coverage": (coverage, "NO"), "boundary": (boundary, "YES")}
    return findings.withColumns({f"{k}_decision": F.when(use, normalize_decision(F.col(c) if isinstance(c, str) else c)).otherwise(F.lit(off)) for (k, (c, off)), use in zip(raw.items(), on, strict=True)})


def candidates(generated: DataFrame) -> DataFrame:
    """Candidates of findings with a generated requirement; dps is kept for the dependency view only."""
    kept = generated.withColumn("requirement", strip(F.coalesce("requirement", F.lit("")))).where("requirement <> ''")
    return kept.withColumns({"candidate_id": stable_id("candidate", F.col("finding_id"), F.col("requirement")), "diagnostic_view": F.col("view"), "dps": F.when(F.col("view") == "dependency", F.col("dps"))})
