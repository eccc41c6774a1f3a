"""Experiment grids: repeated runs, ablations that share preparations, rankings compared at equal budgets."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specweave.operators import ranking

from specweave.plans import pipeline as p
from specweave.plans.model import Caller, ModelConfig
from specweave.storage import stage

# The ablation variants by name and the switches each turns off; the last six are the finer ones.
VARIANTS = {
    "Full pipeline": (),
    "Without Dependency View": ("dependency_view",),
    "Without Operation View": ("operation_view",),
    "Without Isolation View": ("isolation_view",),
    "Without Cross-Req. Extraction": ("cross_requirement_extraction",),
    "DPS → Unranked": ("use_dps_ranking",),
    "Without Evidence Validation": ("evidence_validation", "coverage_validation", "boundary_validation"),
    "Without Consolidation and Refinement": ("consolidation", "refinement", "deduplication", "final_filtering"),
    "Without Coverage Validation": ("coverage_validation",),
    "Without Boundary Validation": ("boundary_validation",),
    "Without Merge": ("consolidation",),
    "Without Refinement": ("refinement",),
    "Without Deduplication": ("deduplication",),
    "Without Final Filtering": ("final_filtering",),
}
EXTENDED = 6
BUDGETS, RANDOM_REPETITIONS = (5, 10, 15, 20), 30


def ablation_configs(budget: int = 20, extended: bool = False) -> dict[str, p.PipelineConfig]:
    base = p.PipelineConfig(dependency_budget=budget)
    names = list(VARIANTS) if extended else list(VARIANTS)[:-EXTENDED]
    return {n: p.without(base, *VARIANTS[n]) for n in names}


def config_table(spark: SparkSession, configs: dict[str, p.PipelineConfig]) -> DataFrame:
    """variant, pos, all switches, and the number of the preparation it shares."""
    shared = {k: i for i, k in enumerate(dict.fromkeys(c.preparation_key for c in configs.values()))}
    return spark.createDataFrame([{"variant": n, "pos": i, "preparation": shared[c.preparation_key]} | asdict(c) for i, (n, c) in enumerate(configs.items())])


def run_ablation(docs: DataFrame, caller: Caller, repetitions: int = 3, configs: dict[str, p.PipelineConfig] | None = None, models: ModelConfig | None = None) -> tuple[DataFrame, int]:
    """(variant, keys and outcome counts, number of preparations made); equal preparation keys are prepared once."""
    configs, ready, rows = configs or ablation_configs(), {}, None
    for name, config in configs.items():
        if config.preparation_key not in ready:
            ready[config.preparation_key] = p.prepare(p.runs_of(docs, repetitions), caller, models, config)
        done = p.run(ready[config.preparation_key], caller, models, config)
        counts = ready[config.preparation_key].docs.select(*p.KEYS)
        for part, outcome in (("kept", "KEEP"), ("demoted", "DEMOTE"), ("removed", "REMOVE")):
            counts = counts.join(done["outcomes"].where(F.col("outcome") == outcome).groupBy(*p.KEYS).agg(F.count(F.lit(1)).alias(part)), p.KEYS, "left")
        counts = counts.join(done["findings"].groupBy(*p.KEYS).agg(F.count(F.lit(1)).alias("findings")), p.KEYS, "left").fillna(0).withColumn("variant", F.lit(name))
        counts = stage(counts, "ablation")
        rows = counts if rows is None else rows.unionByName(counts)
    return rows, len(ready)


def run_rankings(docs: DataFrame, caller: Caller, budgets=BUDGETS, signals=ranking.STRATEGIES, random_repetitions: int = RANDOM_REPETITIONS, models: ModelConfig | None = None) -> DataFrame:
    """A row per keys, signal, draw and budget: effective size, valid records, precision. One preparation serves all.

    Each condition ranks the pool and cuts it before nomination; equal requests of different conditions share one
    response. Random draws are seeded by their number and reported each.
    """
    if not budgets or any(b < 1 for b in budgets) or random_repetitions < 1 or any(s not in ranking.STRATEGIES for s in signals):
        raise ValueError("budgets and repetitions must be positive and signals known")
    models = models or ModelConfig()
    config = p.PipelineConfig(isolation_view=False, operation_view=False, consolidation=False, refinement=False, deduplication=False, final_filtering=False, dependency_budget=max(budgets))
    ready, rows = p.prepare(p.runs_of(docs, 1), caller, models, config), None
    for signal in signals:
        for draw in range(random_repetitions if signal == "random" else 1):
            ranked = stage(ranking.cut(ranking.rank_records(ready.records, signal, p.KEYS, draw), max(budgets)), "ranked")
            found = p.validated(stage(p.nominate_dependency(ranked, ready, caller, models), "findings"), ready, caller, models, config)
            got = ranking.precision_at_budget(ranking.budget_grid(ranked, list(budgets)), found, p.KEYS, ["nominal_budget"])
            got = stage(got.withColumns({"ranking_signal": F.lit(signal), "repetition": F.lit(draw)}), "condition")
            rows = got if rows is None else rows.unionByName(got)
    return rows
