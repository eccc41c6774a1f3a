"""Ranking a fixed pool of records by one signal, and cutting it to budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specweave.functions.scalars import eligible

STRATEGIES = ("dps", "extraction_support", "topology", "unranked", "random")


def rank_records(records: DataFrame, strategy: str, keys: list[str], seed: int = 0) -> DataFrame:
    """records with ``rank`` from 1; ties only by source and target. Scores are compared at 12 decimals.

    ``random`` orders by a seeded hash of the record: fixed by seed, independent of partitioning.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"Unknown ranking strategy: {strategy}")
    signal = {
        "dps": [F.desc(F.round("dps", 12))], "extraction_support": [F.desc(F.round("extraction_support", 12))], "topology": [F.asc("shortest_path_length")],
        "unranked": [], "random": [F.xxhash64(F.lit(seed), F.col("record_id"))],
    }[strategy]
    return records.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*signal, "source", "target")))


def cut(ranked: DataFrame, budget: int) -> DataFrame:
    """The first ``budget`` records of each pool."""
    return ranked.where(F.col("rank") <= budget)


def budget_grid(ranked: DataFrame, budgets: list[int]) -> DataFrame:
    """Nested prefixes of one ranking: a row per record and budget that covers it; no second sort."""
    return ranked.withColumn("nominal_budget", F.explode(F.array(*map(F.lit, budgets)))).where("rank <= nominal_budget")


def precision_at_budget(grid: DataFrame, findings: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Per budget: effective size, records with an eligible finding on their pair, and their share (0 if empty)."""
    good = findings.where(eligible(F.col("evidence_decision"), F.col("coverage_decision"), F.col("boundary_decision"))).select(*keys, F.col("source_element").alias("source"), F.col("target_element").alias("target"), F.lit(True).alias("_good")).distinct()
    joined = grid.join(good, [*keys, "source", "target"], "left")
    counted = joined.groupBy(*keys, *by).agg(F.count(F.lit(1)).alias("effective_budget"), F.count_distinct(F.when(F.col("_good"), F.col("record_id"))).alias("auto_valid_record_count"))
    return counted.withColumn("auto_valid_precision", F.coalesce(F.try_divide("auto_valid_record_count", "effective_budget"), F.lit(0.0)))
