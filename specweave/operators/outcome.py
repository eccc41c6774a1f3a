"""Consolidation: groups of candidates become kept, demoted or removed rows; nothing is lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specweave.functions.scalars import flatten_unique, stable_id, strip


def _names(c: str) -> Column:
    """Sorted distinct non-empty values joined by ``|``."""
    return F.array_join(F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c)))), "|")


def _union(c: str) -> Column:
    return flatten_unique(F.transform(F.array_sort(F.collect_list(F.struct(F.col("_at").alias("o"), F.coalesce(F.col(c), F.array().cast("array<string>")).alias("v")))), lambda x: x["v"]))


def consolidate(candidates: DataFrame, groups: DataFrame, keys: list[str], strict_partition: bool = False) -> DataFrame:
    """One row per outcome: outcome (KEEP, DEMOTE, REMOVE), seq, candidate_id, requirement, reason and merged fields.

    groups: keys, pos, decision, source_candidate_ids, requirement, reason. Unknown ids are dropped, groups
    without a known id are skipped. KEEP needs a requirement; any other decision but DEMOTE removes. Candidates
    in no group are kept. An id named by two groups shows up in both unless strict_partition gives it to the first.
    """
    last = Window.partitionBy(*keys, "candidate_id").orderBy(F.desc("seq"))
    by_id = candidates.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    listed = groups.select(*keys, "pos", F.upper(strip(F.coalesce("decision", F.lit("")))).alias("decision"), strip(F.coalesce("requirement", F.lit(""))).alias("text"), strip(F.coalesce("reason", F.lit(""))).alias("reason"), F.posexplode("source_candidate_ids").alias("_at", "candidate_id"))
    if strict_partition:
        first = Window.partitionBy(*keys, "candidate_id").orderBy("pos", "_at")
        listed = listed.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    known = listed.join(by_id, [*keys, "candidate_id"])
    ids = F.transform(F.array_sort(F.collect_list(F.struct("_at", "candidate_id"))), lambda x: x["candidate_id"])
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "requirement"))), lambda x: x["requirement"]), "|")
    merged = known.groupBy(*keys, "pos", "decision", "text", "reason").agg(
        ids.alias("source_candidate_ids"), texts.alias("_texts"), _names("diagnostic_view").alias("diagnostic_view"), _names("gap_type").alias("gap_type"), _union("source_frs").alias("source_frs"), _union("supporting_excerpts").alias("supporting_excerpts"),
        _names("relation_type").alias("relation_type"), _union("dependency_path").alias("dependency_path"), _names("affected_element").alias("affected_element"), F.max("dps").alias("dps"),
    )
    outcome = F.when(F.col("decision") == "DEMOTE", "DEMOTE").when((F.col("decision") == "KEEP") & (F.col("text") != ""), "KEEP").otherwise("REMOVE")
    null_if_empty = lambda c: F.when(F.col(c) != "", F.col(c))
    keep, remove = F.col("outcome") == "KEEP", F.col("outcome") == "REMOVE"
    new_id = F.concat(F.lit("consolidated-"), F.substring(F.sha2(F.concat_ws("||", F.concat("source_candidate_ids", F.array("text"))), 256), 1, 16))
    grouped = merged.withColumn("outcome", outcome).withColumns({
        "candidate_id": F.when(keep, new_id), "requirement": F.when(remove & (F.col("text") == ""), F.col("_texts")).otherwise(F.col("text")), "reason": F.when(remove & (F.col("reason") == ""), "rejected by consolidation").otherwise(F.col("reason")),
        "relation_type": null_if_empty("relation_type"), "affected_element": F.when(keep, null_if_empty("affected_element")).otherwise(F.col("affected_element")), "order": F.col("pos").cast("long"),
    })
    rest = candidates.join(known.select(*keys, "candidate_id").distinct(), [*keys, "candidate_id"], "left_anti")
    rest = rest.withColumns({"outcome": F.lit("KEEP"), "reason": F.lit(""), "source_candidate_ids": F.array("candidate_id"), "order": F.lit(1 << 40) + F.col("seq"), "_id": stable_id("consolidated", F.col("candidate_id"), F.col("requirement"))}).withColumn("candidate_id", F.col("_id"))
    columns = [*keys, "outcome", "candidate_id", "requirement", "reason", "source_candidate_ids", "diagnostic_view", "gap_type", "source_frs", "supporting_excerpts", "relation_type", "dependency_path", "affected_element", "dps", "order"]
    both = grouped.select(columns).unionByName(rest.select(columns))
    return both.withColumn("seq", F.row_number().over(Window.partitionBy(*keys, "outcome").orderBy("order"))).drop("order")


def pass_through(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """All candidates kept with their own ids: what consolidation gives when all its switches are off."""
    return candidates.select(*keys, F.lit("KEEP").alias("outcome"), "candidate_id", "requirement", F.lit("").alias("reason"), F.array("candidate_id").alias("source_candidate_ids"), "diagnostic_view", "gap_type", "source_frs", "supporting_excerpts", "relation_type", "dependency_path", "affected_element", "dps", "seq")
