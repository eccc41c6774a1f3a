"""Review queries: merging, aliases, patterns, decisions, coercion, outcomes, ablations, the stub pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specweave.functions.scalars import coerce_confidence, coerce_float, coerce_str, coerce_str_list, normalize_decision, stable_id, to_confidence
from specweave.operators import entities, outcome, review
from specweave.plans.experiments import ablation_configs, config_table
from specweave.plans.model import Caller, StubClient
from specweave.plans.pipeline import prepare, run, runs_of
from specweave.queries.graph import table

DOC = ["doc"]
_TYPES = ["ENABLES", "TRIGGERS", "PREVENTS", "MODIFIES", "CONTROLS"]


def merge_entities(spark, sf_dir):
    """Parts as elements named by brand and first type word, with sizes as requirement ids."""
    p = table(spark, sf_dir, "part")
    e = p.select(
        F.lit("all").alias("doc"), F.col("p_partkey").alias("seq"), F.concat(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(F.lower("p_brand")), F.when(F.col("p_partkey") % 3 == 0, "  X").otherwise(" x")).alias("name"), F.lit("DATA").alias("element_type"),
        F.round(F.lit(0.5) + F.col("p_size") / 100, 4).alias("confidence"), F.array(F.concat(F.lit("FR-"), F.col("p_size").cast("string"))).alias("source_frs"), F.array("p_type").alias("supporting_excerpts"), F.array("p_name").alias("aliases"), F.col("p_name").alias("description"),
    )
    m = entities.merge_elements(entities.valid_elements(e), DOC)
    return m.select(F.lower("name").alias("key"), "name", "confidence", F.array_join("source_frs", ",").alias("source_frs"), F.size("supporting_excerpts").cast("bigint").alias("n_excerpts"), F.md5("description").alias("description_md5"))


def alias_join(spark, sf_dir):
    """Nations by name or by a shared alias; the last nation that claims the alias has it."""
    n = table(spark, sf_dir, "nation").select(F.lit("all").alias("doc"), F.col("n_nationkey").alias("seq"), F.col("n_name").alias("name"), F.array(F.concat(F.lit("R"), F.col("n_regionkey").cast("string"))).alias("aliases"))
    a = entities.alias_map(n, DOC)
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("r"), (F.col("c_nationkey") % 7).cast("string")).alias("alias"))
    return c.join(a, "alias").groupBy("alias", "name").agg(F.count(F.lit(1)).alias("n_customers"))


def _orders(spark, sf_dir) -> DataFrame:
    kinds = F.array(*map(F.lit, _TYPES))
    o = table(spark, sf_dir, "orders")
    return o.withColumns({"relation_type": F.element_at(kinds, (F.col("o_orderkey") % 5 + 1).cast("int")), "record_id": F.col("o_orderkey").cast("string"), "doc": F.lit("all")})


def pattern_lookup(spark, sf_dir):
    r = _orders(spark, sf_dir).withColumn("relation_types", F.array("relation_type", F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("o_custkey") % 5 + 1).cast("int"))))
    return review.with_patterns(r, DOC).groupBy(F.array_join("patterns", "|").alias("patterns")).agg(F.count(F.lit(1)).alias("n_records"))


def finding_filter(spark, sf_dir):
    """Nominated gaps survive only if the record's patterns hold them."""
    r = review.with_patterns(_orders(spark, sf_dir).withColumn("relation_types", F.array("relation_type")), DOC)
    gap = F.element_at(F.array(*map(F.lit, ("missing_audit", " MISSING_FALLBACK", "MISSING_ROLLBACK ", "NONE"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    empty = F.array().cast("array<string>")
    items = r.withColumns({"gap_type": gap, "item_frs": empty, "excerpts": empty, "record_frs": F.array("o_orderpriority"), "affected": F.lit(""), "raw_affected": F.lit(""), "reason": F.lit(""), "source": F.lit("S"), "target": F.col("o_orderstatus"), "path": F.array(F.lit("S"), F.col("o_orderstatus"))})
    f = review.dependency_findings(items)
    return f.groupBy("relation_type", "gap_type", "affected_element").agg(F.count(F.lit(1)).alias("n_findings"), F.min("finding_id").alias("least_id"))


def decision_gate(spark, sf_dir):
    o = _orders(spark, sf_dir).withColumns({"e": F.element_at(F.array(F.lit("yes "), F.lit("No"), F.lit("?"), F.lit("YES")), (F.col("o_orderkey") % 4 + 1).cast("int")), "c": F.when(F.col("o_orderstatus") == "F", "no").otherwise(F.lit(None)), "b": F.lit("Yes")})
    d = review.decide(o, "e", "c", "b", (F.lit(True), F.lit(True), F.lit(True)))
    ok = review_eligible(d)
    return d.groupBy("evidence_decision", "coverage_decision", "boundary_decision").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_eligible"))


def review_eligible(d: DataFrame):
    from specweave.functions.scalars import eligible

    return eligible(d["evidence_decision"], d["coverage_decision"], d["boundary_decision"])


def ablation_grid(spark, sf_dir):
    """All variants over all order priorities: how many findings each variant's gates let through."""
    cfg = F.broadcast(config_table(spark, ablation_configs(20, True)))  # fourteen rows
    o = _orders(spark, sf_dir).groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n")).join(cfg)
    d = review.decide(o, F.when(F.col("o_orderstatus") == "F", "YES").otherwise("NO"), F.when(F.col("o_orderpriority") < "3", "NO").otherwise("YES"), F.lit("yes"), (F.col("evidence_validation"), F.col("coverage_validation"), F.col("boundary_validation")))
    passed = F.coalesce(F.sum(F.when(review_eligible(d) & F.col("dependency_view"), F.col("n"))), F.lit(0))
    return d.groupBy("variant", F.col("preparation").cast("bigint").alias("preparation")).agg(passed.alias("n_passed"))


def json_coerce(spark, sf_dir):
    v = F.try_parse_json("props")
    e = table(spark, sf_dir, "events").select("event_type", coerce_float(F.try_variant_get(v, "$.k", "variant")).alias("k"), coerce_str(F.try_variant_get(v, "$.none", "variant"), "absent").alias("none"))
    return e.groupBy("event_type", "none").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("sum_k"), F.max("k").alias("max_k"))


def confidence_norm(spark, sf_dir):
    """Scores of 0 to 100 (and shifted ones) on the unit interval."""
    v = F.try_parse_json("props")
    k = F.try_variant_get(v, "$.k", "double")
    e = table(spark, sf_dir, "events").select("event_type", coerce_confidence(F.try_variant_get(v, "$.k", "variant")).alias("c"), to_confidence(k * 2 - 20).alias("d"))
    return e.groupBy("event_type").agg(F.round(F.sum("c"), 6).alias("sum_c"), F.round(F.sum("d"), 6).alias("sum_d"), F.count_if(F.col("d") == 0).alias("n_zero"))


def coerce_lists(spark, sf_dir):
    """Lists, lone strings, nulls and objects from text columns, coerced to lists of texts."""
    raw = F.when(F.col("turn") % 3 == 0, F.to_json(F.array("role", F.lit(" x "), F.lit(None), F.lit("")))).when(F.col("turn") % 3 == 1, F.concat(F.lit('"'), F.col("role"), F.lit(' "'))).otherwise(F.lit('{"a": 1}'))
    c = table(spark, sf_dir, "conversations").select((F.col("turn") % 3).alias("kind"), coerce_str_list(F.try_parse_json(raw)).alias("v"))
    return c.groupBy("kind", F.array_join("v", "|").alias("v")).agg(F.count(F.lit(1)).alias("n"))


def decisions_norm(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(normalize_decision(F.when(F.col("turn") % 2 == 0, F.lit(" yes")).otherwise(F.col("role"))).alias("decision"))
    return c.groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


def stable_ids(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", stable_id("record", F.col("s_name"), F.when(F.col("s_nationkey") > 5, F.col("s_nationkey"))).alias("id"))


def _judged(spark, sf_dir):
    """Labels as candidates in documents of 40 ids; groups of four by a decision that their number picks."""
    l = table(spark, sf_dir, "labels")
    c = l.select(
        F.floor(F.col("doc_id") / 40).alias("doc"), F.col("doc_id").alias("seq"), F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("candidate_id"), F.concat(F.lit("need "), F.col("doc_id").cast("string")).alias("requirement"), F.when(F.col("toxic") == 1, "isolation").otherwise("dependency").alias("diagnostic_view"),
        F.concat(F.lit("G"), F.col("quality").cast("string")).alias("gap_type"), F.array(F.concat(F.lit("FR-"), (F.col("doc_id") % 5).cast("string"))).alias("source_frs"), F.array(F.lit("x")).alias("supporting_excerpts"), F.lit(None).cast("string").alias("relation_type"), F.array("candidate_id").alias("dependency_path"),
        F.when(F.col("quality") == 1, F.concat(F.lit("E"), (F.col("doc_id") % 3).cast("string"))).alias("affected_element"), F.when(F.col("quality") == 1, F.col("doc_id") / 1000).alias("dps"),
    )
    g = c.where("seq % 10 < 7").withColumn("pos", F.floor(F.col("seq") / 4)).groupBy("doc", "pos").agg(F.array_sort(F.collect_list("candidate_id")).alias("source_candidate_ids"))
    decision = F.element_at(F.array(F.lit("keep"), F.lit("DEMOTE"), F.lit("REMOVE"), F.lit("KEEP")), (F.col("pos") % 4 + 1).cast("int"))
    g = g.withColumns({"source_candidate_ids": F.concat("source_candidate_ids", F.array(F.lit("ghost"))), "decision": decision, "requirement": F.when(F.col("pos") % 4 == 3, "").otherwise(F.concat(F.lit("group "), F.col("pos").cast("string"))), "reason": F.lit("")})
    return c, g


def outcome_partition(spark, sf_dir):
    c, g = _judged(spark, sf_dir)
    o = outcome.consolidate(c, g, DOC)
    return o.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("source_candidate_ids")).alias("n_candidates"), F.count("dps").alias("n_dps"), F.round(F.max("dps"), 6).alias("most_dps"))


def group_merge(spark, sf_dir):
    c, g = _judged(spark, sf_dir)
    o = outcome.consolidate(c, g, DOC).where(F.size("source_candidate_ids") > 1)
    return o.select("doc", "outcome", "requirement", "reason", F.array_join("source_candidate_ids", ",").alias("ids"), "diagnostic_view", "gap_type", F.coalesce("affected_element", F.lit("-")).alias("affected_element"), F.array_join("source_frs", ",").alias("source_frs"), F.round("dps", 6).alias("dps"))


def unclaimed_fallback(spark, sf_dir):
    c, g = _judged(spark, sf_dir)
    claimed = g.select("doc", F.explode("source_candidate_ids").alias("candidate_id"))
    return outcome.consolidate(c, g, DOC).where("outcome = 'KEEP' AND size(source_candidate_ids) = 1").join(claimed.select("doc", F.array("candidate_id").alias("source_candidate_ids")), ["doc", "source_candidate_ids"], "left_anti").select("doc", "candidate_id", "requirement")


def model_stub_pipeline(spark, sf_dir):
    """The whole pipeline with the offline client over specifications made of the region table."""
    r = table(spark, sf_dir, "region")
    text = F.concat(F.lit("1.1 Register "), F.col("r_name"), F.lit("\nInput\n1.2 Search "), F.col("r_name"), F.lit("\nOutput\n1.3 Report"))
    docs = r.select(F.lit("S").alias("system_id"), F.col("r_name").alias("document_id"), text.alias("text"))
    caller = Caller(spark, StubClient(), sleep=_no_sleep)
    done = run(prepare(runs_of(docs, 1), caller), caller)
    return done["kept"].select("document_id", "seq", "fr_number", "requirement", "gap_type", F.round("dps", 6).alias("dps"))


def _no_sleep(seconds: float) -> None:
    """The stub never fails, so there is nothing to wait for."""


QUERIES = {f.__name__: f for f in (merge_entities, alias_join, pattern_lookup, finding_filter, decision_gate, ablation_grid, json_coerce, confidence_norm, coerce_lists, decisions_norm, stable_ids, outcome_partition, group_merge, unclaimed_fallback, model_stub_pipeline)}

_PATTERNS = ", ".join(f"('{t}', '{p}')" for t, ps in review.REVIEW_PATTERNS.items() for p in ps)
_O = "o AS (SELECT *, (['ENABLES', 'TRIGGERS', 'PREVENTS', 'MODIFIES', 'CONTROLS'])[o_orderkey % 5 + 1] AS relation_type, (['ENABLES', 'TRIGGERS', 'PREVENTS', 'MODIFIES', 'CONTROLS'])[o_custkey % 5 + 1] AS other FROM orders), pt(rt, pattern) AS (VALUES " + _PATTERNS + ")"
_EV = "e AS (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)"
_J = """
c AS (SELECT doc_id // 40 AS doc, doc_id, 'c' || doc_id AS cid, 'need ' || doc_id AS req, CASE WHEN toxic = 1 THEN 'isolation' ELSE 'dependency' END AS view, 'G' || quality AS gap, 'FR-' || (doc_id % 5) AS fr, CASE WHEN quality = 1 THEN 'E' || (doc_id % 3) END AS el, CASE WHEN quality = 1 THEN doc_id / 1000 END AS dps FROM labels),
m AS (SELECT doc, doc_id // 4 AS pos, list(cid ORDER BY cid) AS ids, string_agg(req, '|' ORDER BY cid) AS reqs, array_to_string(list_sort(list_distinct(list(view))), '|') AS diagnostic_view, array_to_string(list_sort(list_distinct(list(gap))), '|') AS gap_type,
  coalesce(array_to_string(list_sort(list_distinct(list(el) FILTER (el IS NOT NULL))), '|'), '') AS els, list(fr ORDER BY cid) AS frs, max(dps) AS dps FROM c WHERE doc_id % 10 < 7 GROUP BY ALL),
g AS (SELECT *, CASE pos % 4 WHEN 0 THEN 'KEEP' WHEN 1 THEN 'DEMOTE' ELSE 'REMOVE' END AS outcome, CASE WHEN pos % 4 = 3 THEN reqs ELSE 'group ' || pos END AS requirement, CASE WHEN pos % 4 IN (2, 3) THEN 'rejected by consolidation' ELSE '' END AS reason FROM m),
u AS (SELECT doc, 'consolidated-' || sha256(cid || '||' || req)[1:16] AS candidate_id, req AS requirement, dps FROM c WHERE NOT doc_id % 10 < 7)"""
_VARIANTS = ", ".join(f"('{n}', {i if 0 else int(not c.cross_requirement_extraction)}, {c.dependency_view}, {c.evidence_validation}, {c.coverage_validation}, {c.boundary_validation})" for i, (n, c) in enumerate(ablation_configs(20, True).items()))
SQL = {
    "merge_entities": """
WITH e AS (SELECT p_partkey AS seq, CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE lower(p_brand) END || CASE WHEN p_partkey % 3 = 0 THEN '  X' ELSE ' x' END AS name, round(0.5 + p_size / 100, 4) AS confidence, p_size, p_type, p_name FROM part),
v AS (SELECT *, lower(regexp_replace(name, '\\s+', ' ', 'g')) AS k FROM e WHERE confidence >= 0.75),
f AS (SELECT k, p_size, min(seq) AS first FROM v GROUP BY ALL), s AS (SELECT k, string_agg('FR-' || p_size, ',' ORDER BY first) AS source_frs FROM f GROUP BY k)
SELECT lower(arg_min(name, (-confidence, seq))) AS key, arg_min(name, (-confidence, seq)) AS name, max(confidence) AS confidence, any_value(source_frs) AS source_frs, count(DISTINCT p_type) AS n_excerpts, md5(arg_min(p_name, (-confidence, seq))) AS description_md5 FROM v JOIN s ON v.k = s.k GROUP BY v.k""",
    "alias_join": "WITH a AS (SELECT 'r' || n_regionkey AS alias, arg_max(n_name, n_nationkey) AS name FROM nation GROUP BY 1) SELECT a.alias, name, count(*) AS n_customers FROM customer JOIN a ON a.alias = 'r' || (c_nationkey % 7) GROUP BY ALL",
    "pattern_lookup": f"WITH {_O}, r AS (SELECT o_orderkey, array_to_string(list_sort(list_distinct(list(pattern))), '|') AS patterns FROM o JOIN pt ON rt IN (relation_type, other) GROUP BY o_orderkey) SELECT patterns, count(*) AS n_records FROM r GROUP BY patterns",
    "finding_filter": f"""WITH {_O}, n AS (SELECT *, (['MISSING_AUDIT', 'MISSING_FALLBACK', 'MISSING_ROLLBACK', 'NONE'])[o_orderkey % 4 + 1] AS gap_type FROM o)
SELECT relation_type, gap_type, o_orderstatus AS affected_element, count(*) AS n_findings, min('finding-' || sha256(o_orderkey || '||' || gap_type || '||')[1:16]) AS least_id FROM n JOIN pt ON rt = relation_type AND pattern = gap_type GROUP BY ALL""",
    "decision_gate": f"""WITH {_O}, d AS (SELECT (['YES', 'NO', 'UNCERTAIN', 'YES'])[o_orderkey % 4 + 1] AS evidence_decision, CASE WHEN o_orderstatus = 'F' THEN 'NO' ELSE 'UNCERTAIN' END AS coverage_decision, 'YES' AS boundary_decision FROM o)
SELECT *, count(*) AS n, count(*) FILTER (evidence_decision = 'YES' AND coverage_decision = 'NO') AS n_eligible FROM d GROUP BY ALL""",
    "ablation_grid": f"""WITH v(variant, preparation, dv, e, c, b) AS (VALUES {_VARIANTS}), o AS (SELECT o_orderpriority AS p, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY ALL)
SELECT variant, CAST(preparation AS BIGINT) AS preparation, CAST(coalesce(sum(n) FILTER (dv AND (NOT e OR s = 'F') AND (NOT c OR p < '3')), 0) AS BIGINT) AS n_passed FROM o, v GROUP BY ALL""",
    "json_coerce": f"WITH {_EV} SELECT event_type, 'absent' AS none, count(*) AS n, sum(coalesce(k, 0.0)) AS sum_k, max(coalesce(k, 0.0)) AS max_k FROM e GROUP BY ALL",
    "confidence_norm": f"""WITH {_EV}, s AS (SELECT event_type, k AS c, k * 2 - 20 AS d FROM e), t AS (SELECT event_type, CASE WHEN c IS NULL OR c < 0 OR c > 100 THEN 0.0 WHEN c > 1 THEN c / 100 ELSE c END AS c, CASE WHEN d IS NULL OR d < 0 OR d > 100 THEN 0.0 WHEN d > 1 THEN d / 100 ELSE d END AS d FROM s)
SELECT event_type, round(sum(c), 6) AS sum_c, round(sum(d), 6) AS sum_d, count(*) FILTER (d = 0) AS n_zero FROM t GROUP BY event_type""",
    "coerce_lists": "SELECT turn % 3 AS kind, CASE turn % 3 WHEN 0 THEN role || '|x' WHEN 1 THEN role ELSE '' END AS v, count(*) AS n FROM conversations GROUP BY ALL",
    "decisions_norm": "SELECT CASE WHEN turn % 2 = 0 THEN 'YES' ELSE 'UNCERTAIN' END AS decision, count(*) AS n FROM conversations GROUP BY 1",
    "stable_ids": "SELECT s_suppkey, 'record-' || sha256(s_name || '||' || coalesce(CAST(CASE WHEN s_nationkey > 5 THEN s_nationkey END AS VARCHAR), 'None'))[1:16] AS id FROM supplier",
    "outcome_partition": f"""WITH {_J}, a AS (SELECT outcome, len(ids) AS k, dps FROM g UNION ALL SELECT 'KEEP', 1, dps FROM u) SELECT outcome, count(*) AS n, CAST(sum(k) AS BIGINT) AS n_candidates, count(dps) AS n_dps, round(max(dps), 6) AS most_dps FROM a GROUP BY outcome""",
    "group_merge": f"""WITH {_J}, f AS (SELECT doc, pos, i, frs[i] AS fr FROM (SELECT *, unnest(range(1, len(frs) + 1)) AS i FROM g)), w AS (SELECT doc, pos, string_agg(fr, ',' ORDER BY i) AS source_frs FROM (SELECT doc, pos, fr, min(i) AS i FROM f GROUP BY ALL) GROUP BY doc, pos)
SELECT g.doc, outcome, requirement, reason, array_to_string(ids, ',') AS ids, diagnostic_view, gap_type, CASE WHEN outcome = 'KEEP' AND els = '' THEN '-' ELSE els END AS affected_element, source_frs, round(dps, 6) AS dps FROM g JOIN w ON g.doc = w.doc AND g.pos = w.pos WHERE len(ids) > 1""",
    "unclaimed_fallback": f"WITH {_J} SELECT doc, candidate_id, requirement FROM u",
}
