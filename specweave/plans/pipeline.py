"""The document pipeline as a plan over tables: prepare (blocks, elements, relations, graph, records), then run.

Tables carry the keys of a run; every stage that asks the model is one wave of distinct requests for all
documents at once.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specweave.functions.scalars import coerce_confidence, coerce_str, coerce_str_list, eligible, variant_kind
from specweave.operators import entities, graph, outcome, ranking, render, review
from specweave.operators.numbering import assign_numbers, numbering_context
from specweave.operators.segments import blocks, context
from specweave.plans.model import Caller, ModelConfig, usage
from specweave.storage import stage

KEYS = ["system_id", "document_id", "run_id"]


@dataclass(frozen=True)
class PipelineConfig:
    dependency_view: bool = True
    isolation_view: bool = True
    operation_view: bool = True
    cross_requirement_extraction: bool = True
    use_dps_ranking: bool = True
    evidence_validation: bool = True
    coverage_validation: bool = True
    boundary_validation: bool = True
    consolidation: bool = True
    refinement: bool = True
    deduplication: bool = True
    final_filtering: bool = True
    dependency_budget: int = 20
    max_parents: int = 12

    @property
    def preparation_key(self) -> tuple:
        """Configurations with equal keys share blocks, elements, relations, graph and records."""
        return self.cross_requirement_extraction, self.max_parents


@dataclass
class Prepared:
    docs: DataFrame
    blocks: DataFrame
    elements: DataFrame
    relations: DataFrame
    edges: DataFrame
    exclusions: DataFrame
    records: DataFrame
    calls: DataFrame


def _field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _items(called: DataFrame, name: str) -> DataFrame:
    """A row per object of a list field of the response, in order; anything else is skipped."""
    out = called.withColumn("_list", _field(F.col("response"), name)).where(variant_kind(F.col("_list")) == "ARRAY")
    out = out.withColumn("_each", F.try_variant_get("_list", "$", "array<variant>")).select("*", F.posexplode("_each").alias("item_pos", "item")).drop("_list", "_each")
    return out.where(variant_kind(F.col("item")) == "OBJECT")


def _ask(rows: DataFrame, task: str, model: str, temperature: float | None, system: str, **payload: Column) -> DataFrame:
    user = F.to_json(F.struct(F.lit(task).alias("task"), *(c.alias(k) for k, c in payload.items())), {"ignoreNullFields": "false"})
    # Repetitions of a document stay independent requests.
    return rows.withColumns({"model": F.lit(model), "temperature": F.lit(temperature).cast("double"), "system": F.lit(system), "user": user, "repetition": F.col("run_id").cast("string")})


def _ordered(c: Column, order: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), c.alias("v")))), lambda x: x["v"])


def runs_of(docs: DataFrame, repetitions: int) -> DataFrame:
    return docs.withColumn("run_id", F.explode(F.sequence(F.lit(1), F.lit(repetitions))))


def prepare(docs: DataFrame, caller: Caller, models: ModelConfig | None = None, config: PipelineConfig | None = None) -> Prepared:
    """Stages 1 and 2 for all runs in docs (system_id, document_id, run_id, text)."""
    models, config = models or ModelConfig(), config or PipelineConfig()
    docs = stage(docs.select(*KEYS, F.coalesce("text", F.lit("")).alias("text")), "docs")
    cut = stage(blocks(docs, KEYS), "blocks")
    asked = caller.call(_ask(cut, "elements", models.extraction_model, models.extraction_temperature, "Extract typed requirement elements as JSON.", requirement_id=F.col("requirement_id"), text=F.col("block")))
    calls = asked.select(*KEYS, "prompt_tokens", "completion_tokens", "api_calls", "error")
    item = F.col("item")
    raw = _items(asked, "elements").select(
        *KEYS, (F.col("seq") * 100_000 + F.col("item_pos")).alias("seq"), coerce_str(_field(item, "name")).alias("name"), F.upper(coerce_str(_field(item, "type"))).alias("element_type"), coerce_confidence(_field(item, "confidence")).alias("confidence"),
        F.array("requirement_id").alias("source_frs"), F.array(coerce_str(_field(item, "supporting_excerpt"))).alias("supporting_excerpts"), coerce_str_list(_field(item, "aliases")).alias("aliases"), coerce_str(_field(item, "description")).alias("description"),
    )
    elements = stage(entities.merge_elements(entities.valid_elements(raw), KEYS), "elements")
    aliases = entities.alias_map(elements, KEYS)

    def relations_of(answered: DataFrame, cross: bool, base: Column) -> DataFrame:
        r = _items(answered, "relations").select(
            *KEYS, (base + F.col("item_pos")).alias("seq"), *(coerce_str(_field(item, c)).alias(c) for c in ("source", "target", "relation_type", "justification")), coerce_confidence(_field(item, "confidence")).alias("confidence"),
            coerce_str_list(_field(item, "source_frs")).alias("source_frs"), coerce_str_list(_field(item, "supporting_excerpts")).alias("supporting_excerpts"),
        )
        return entities.valid_relations(r, aliases, KEYS, cross)

    cited = elements.select(*KEYS, F.explode("source_frs").alias("requirement_id"), "name", F.col("seq").alias("_e"))
    busy = cut.join(cited, [*KEYS, "requirement_id"]).groupBy(*KEYS, "requirement_id", "seq", "block").agg(_ordered(F.col("name"), "_e").alias("names")).where(F.size("names") >= 2)
    inner = caller.call(_ask(busy, "relations", models.extraction_model, models.extraction_temperature, "Extract typed relations as JSON.", elements=F.col("names"), ids=F.array("requirement_id"), text=F.col("block")))
    calls = calls.unionByName(inner.select(calls.columns))
    relations = stage(entities.dedup_relations(relations_of(inner, False, F.col("seq") * 100_000), KEYS), "relations")
    if config.cross_requirement_extraction:
        names = elements.groupBy(*KEYS).agg(_ordered(F.col("name"), "seq").alias("names"))
        apart = entities.isolated(elements, relations, KEYS).groupBy(*KEYS).agg(F.array_sort(F.collect_set("name")).alias("apart"))
        seen = relations.groupBy(*KEYS).agg(_ordered(F.struct("source", "target", "relation_type", "confidence"), "seq").alias("seen"))
        rows = docs.join(names, KEYS).join(apart, KEYS, "left").join(seen, KEYS, "left")
        outer = caller.call(_ask(rows, "relations", models.extraction_model, models.extraction_temperature, "Find relations across requirements as JSON.", elements=F.col("names"), existing=F.col("seen"), disconnected=F.col("apart"), text=F.col("text")))
        calls = calls.unionByName(outer.select(calls.columns))
        relations = stage(entities.dedup_relations(relations.unionByName(relations_of(outer, True, F.lit(1 << 50)).select(relations.columns)), KEYS), "relations")
    edges, exclusions = graph.build(elements, relations, KEYS, config.max_parents)
    edges = stage(edges, "edges")
    records = stage(graph.ranking_records(graph.paths(edges, KEYS), edges, KEYS), "records")
    return Prepared(docs, cut, elements, relations, edges, exclusions, records, stage(calls, "calls"))


def _spent(log: list[DataFrame] | None, called: DataFrame) -> DataFrame:
    """called, with what it cost noted in log."""
    if log is not None:
        log.append(called.select(*KEYS, "prompt_tokens", "completion_tokens", "api_calls", "error"))
    return called


def validated(findings: DataFrame, p: Prepared, caller: Caller, models: ModelConfig, config: PipelineConfig, log: list[DataFrame] | None = None) -> DataFrame:
    payload = [c for c in findings.columns if c not in KEYS]
    asked = _spent(log, caller.call(_ask(findings.join(p.docs, KEYS), "validate", models.validation_model, models.validation_temperature, "Validate a finding as JSON.", finding=F.struct(*payload), text=F.col("text"))))
    said = lambda part: F.when(variant_kind(_field(F.col("response"), part)) == "OBJECT", coerce_str(_field(_field(F.col("response"), part), "decision"))).otherwise(F.lit(""))
    # A call is made even where a decision is overridden.
    return review.decide(asked, said("evidence"), said("coverage"), said("boundary"), (F.lit(config.evidence_validation), F.lit(config.coverage_validation), F.lit(config.boundary_validation)))


FINDING = ["finding_id", "view", "gap_type", "source_frs", "supporting_excerpts", "source_element", "target_element", "affected_element", "relation_type", "dependency_path", "dps", "nomination_reason", "order"]


def _findings(df: DataFrame) -> DataFrame:
    kinds = {"dps": "double", "dependency_path": "array<string>", "order": "long"}
    return df.select(*KEYS, *(F.col(c) if c in df.columns else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in FINDING))


def _fields(item: Column) -> dict[str, Column]:
    return {"gap_type": coerce_str(_field(item, "gap_type")), "item_frs": coerce_str_list(_field(item, "source_frs")), "excerpts": coerce_str_list(_field(item, "supporting_excerpts")), "reason": coerce_str(_field(item, "reason"))}


def nominate_dependency(selected: DataFrame, p: Prepared, caller: Caller, models: ModelConfig, log: list[DataFrame] | None = None) -> DataFrame:
    """Findings of ranked records; one request per record that has review patterns."""
    rows = review.with_patterns(review.with_sources(selected, p.elements, KEYS), KEYS)
    rows = context(rows, p.blocks, p.docs, KEYS, "record_frs")
    asked = _spent(log, caller.call(_ask(rows, "dependency", models.validation_model, models.validation_temperature, "Nominate findings as JSON.", source=F.col("source"), target=F.col("target"), path=F.col("path"), relation_types=F.col("relation_types"), patterns=F.col("patterns"), text=F.col("context"))))
    affected = _field(F.col("item"), "affected_element")
    raw = F.when(affected.isNull(), F.lit("")).when(variant_kind(affected) == "VOID", F.lit(None)).otherwise(F.try_variant_get(affected, "$", "string"))
    items = _items(asked, "findings").withColumns(_fields(F.col("item")) | {"affected": coerce_str(affected), "raw_affected": raw, "order": F.col("rank") * 1000 + F.col("item_pos")})
    return _findings(review.dependency_findings(items))


def nominate_isolation(p: Prepared, caller: Caller, models: ModelConfig, log: list[DataFrame] | None = None) -> DataFrame:
    alone = context(entities.isolated(p.elements, p.relations, KEYS), p.blocks, p.docs, KEYS, "source_frs")
    asked = _spent(log, caller.call(_ask(alone, "isolation", models.validation_model, models.validation_temperature, "Classify a disconnected element as JSON.", element=F.col("name"), element_type=F.col("element_type"), excerpts=F.col("supporting_excerpts"), text=F.col("context"))))
    answer = F.col("response")
    return _findings(review.isolation_findings(asked.withColumns(_fields(answer) | {"label": coerce_str(_field(answer, "label")), "order": F.lit(1 << 30) + F.col("seq")})))


def nominate_operation(p: Prepared, caller: Caller, models: ModelConfig, log: list[DataFrame] | None = None) -> DataFrame:
    fit = p.elements.where(F.col("element_type").isin("DATA", "FUNCTION")).groupBy(*KEYS).agg(_ordered(F.col("name"), "seq").alias("names"))
    asked = _spent(log, caller.call(_ask(fit.join(p.docs, KEYS), "operation", models.validation_model, models.validation_temperature, "Diagnose operation coverage as JSON.", elements=F.col("names"), text=F.col("text"))))
    items = _items(asked, "findings").withColumns(_fields(F.col("item")) | {"affected": coerce_str(_field(F.col("item"), "affected_element")), "order": F.lit(1 << 40) + F.col("item_pos")})
    return _findings(review.operation_findings(items))


def generate(findings: DataFrame, p: Prepared, caller: Caller, models: ModelConfig, log: list[DataFrame] | None = None) -> DataFrame:
    """Candidates of eligible findings; the request leaves dps and the reviewers' reasons out."""
    fit = findings.where(eligible(F.col("evidence_decision"), F.col("coverage_decision"), F.col("boundary_decision"))).select(*KEYS, *FINDING, "boundary_decision")
    rows = context(fit, p.blocks, p.docs, KEYS, "source_frs").join(p.elements.groupBy(*KEYS).agg(_ordered(F.col("name"), "seq").alias("names")), KEYS, "left")
    sent = ["finding_id", "view", "gap_type", "source_frs", "supporting_excerpts", "source_element", "target_element", "affected_element", "relation_type", "dependency_path", "nomination_reason", "boundary_decision"]
    asked = _spent(log, caller.call(_ask(rows, "generate", models.generation_model, models.generation_temperature, "Generate a requirement as JSON.", **{c: F.col(c) for c in sent}, text=F.col("context"), element_names=F.col("names"))))
    made = asked.withColumn("requirement", coerce_str(_field(F.col("response"), "requirement")))
    return review.candidates(made).withColumn("seq", F.col("order"))


def consolidated(candidates: DataFrame, p: Prepared, caller: Caller, models: ModelConfig, config: PipelineConfig, log: list[DataFrame] | None = None) -> DataFrame:
    if not (config.consolidation or config.refinement or config.deduplication or config.final_filtering):
        return outcome.pass_through(candidates, KEYS)
    rows = candidates.groupBy(*KEYS).agg(_ordered(F.col("candidate_id"), "seq").alias("ids"), _ordered(F.struct("candidate_id", "requirement", "gap_type", "affected_element"), "seq").alias("listed")).join(p.docs, KEYS)
    switches = {k: F.lit(getattr(config, k)) for k in ("consolidation", "refinement", "deduplication", "final_filtering")}
    asked = _spent(log, caller.call(_ask(rows, "consolidate", models.validation_model, models.validation_temperature, "Consolidate candidates as JSON.", ids=F.col("ids"), candidates=F.col("listed"), text=F.col("text"), **switches)))
    item = F.col("item")
    groups = _items(asked, "candidates").select(*KEYS, F.col("item_pos").alias("pos"), *(coerce_str(_field(item, c)).alias(c) for c in ("decision", "requirement", "reason")), coerce_str_list(_field(item, "source_candidate_ids")).alias("source_candidate_ids"))
    return outcome.consolidate(candidates, groups, KEYS)


def run(p: Prepared, caller: Caller, models: ModelConfig | None = None, config: PipelineConfig | None = None, signal: str | None = None, seed: int = 0) -> dict[str, DataFrame]:
    """Stages 3 to 5: findings, candidates, outcomes (kept ones numbered) and the three documents per run."""
    models, config = models or ModelConfig(), config or PipelineConfig()
    found: list[DataFrame] = []
    log = [p.calls]
    ranked = ranking.rank_records(p.records, signal or ("dps" if config.use_dps_ranking else "unranked"), KEYS, seed)
    selected = ranking.cut(ranked, config.dependency_budget)
    if config.dependency_view:
        found.append(nominate_dependency(selected, p, caller, models, log))
    if config.isolation_view:
        found.append(nominate_isolation(p, caller, models, log))
    if config.operation_view:
        found.append(nominate_operation(p, caller, models, log))
    empty = _findings(p.docs.where("false").withColumns({"finding_id": F.lit(""), "source_frs": F.array().cast("array<string>"), "supporting_excerpts": F.array().cast("array<string>")}))
    findings = empty
    for f in found:
        findings = findings.unionByName(f)
    findings = stage(validated(stage(findings, "findings"), p, caller, models, config, log).drop("response"), "validated")
    candidates = stage(generate(findings, p, caller, models, log), "candidates")
    outcomes = stage(consolidated(candidates, p, caller, models, config, log), "outcomes")
    numbers = numbering_context(p.docs, p.blocks, KEYS)
    kept = stage(assign_numbers(outcomes.where("outcome = 'KEEP'"), numbers, KEYS), "kept")
    demoted, removed = outcomes.where("outcome = 'DEMOTE'"), outcomes.where("outcome = 'REMOVE'")
    return {
        "selected": selected, "findings": findings, "candidates": candidates, "outcomes": outcomes, "kept": kept, "usage": usage(reduce(DataFrame.unionByName, log), KEYS),
        "refined": render.refined_documents(p.docs, kept, numbers, KEYS), "design_constraints": render.design_constraints(p.docs, demoted, removed, KEYS), "report": render.refinement_report(p.docs, numbers, kept, demoted, removed, KEYS),
    }


def without(config: PipelineConfig, *switches: str) -> PipelineConfig:
    return replace(config, **dict.fromkeys(switches, False))
