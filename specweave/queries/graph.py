"""Graph queries: trade between nations as a weighted dependency graph.

A typed edge runs from a supplier's nation to a customer's nation of greater key (so the graph is acyclic), its
type is the order priority, its confidence the number of line items over the most for that customer nation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specweave.operators import graph as g
from specweave.operators import ranking as r
from specweave.operators.entities import dedup_relations, isolated
from specweave.storage import stage

KEYS = ["doc"]
PARENTS = 3
BUDGETS = [5, 10, 15, 20]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def typed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, source, target, relation_type, confidence, seq."""
    t = lambda name: table(spark, sf_dir, name)
    sold = t("lineitem").select("l_orderkey", "l_suppkey").join(t("orders").select("o_orderkey", "o_custkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    sold = sold.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).where("s_nationkey < c_nationkey")
    counts = sold.groupBy("s_nationkey", "c_nationkey", F.col("o_orderpriority").alias("relation_type")).agg(F.count(F.lit(1)).alias("n"))
    share = F.round(F.col("n") / F.max("n").over(Window.partitionBy("c_nationkey")), 6)
    # One row per pair of nations and priority: a few thousand at any scale factor.
    names = F.broadcast(t("nation").select(F.col("n_nationkey"), F.col("n_name")))
    edges = counts.select("s_nationkey", "c_nationkey", "relation_type", share.alias("confidence"))
    edges = edges.join(names.withColumnsRenamed({"n_nationkey": "s_nationkey", "n_name": "source"}), "s_nationkey").join(names.withColumnsRenamed({"n_nationkey": "c_nationkey", "n_name": "target"}), "c_nationkey")
    order = Window.partitionBy("doc").orderBy("source", "target", "relation_type")
    return edges.withColumn("doc", F.lit("trade")).withColumn("seq", F.row_number().over(order)).select("doc", "source", "target", "relation_type", "confidence", "seq")


def _edges(spark, sf_dir) -> DataFrame:
    pairs = g.collapse_pairs(typed_edges(spark, sf_dir).withColumn("edge_key", F.concat(F.lit("relation-"), (F.col("seq") - 1).cast("string"))), KEYS)
    return stage(g.limit_parents(pairs, KEYS, PARENTS)[0], "edges")  # read by each step of the search


def _records(spark, sf_dir) -> DataFrame:
    edges = _edges(spark, sf_dir)
    return g.ranking_records(g.paths(edges, KEYS), edges, KEYS)


def _shown(records: DataFrame, *more: str) -> DataFrame:
    return records.select(
        "source", "target", F.round("dps", 6).alias("dps"), F.round("extraction_support", 6).alias("extraction_support"), F.col("shortest_path_length").cast("bigint").alias("shortest_path_length"),
        F.array_join("path", ">").alias("path"), F.array_join("relation_types", "|").alias("relation_types"), "record_id", *more,
    )


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(r.cut(r.rank_records(_records(spark, sf_dir), "dps", KEYS), 20), "rank")


def pair_collapse(spark, sf_dir):
    t = typed_edges(spark, sf_dir).withColumn("edge_key", F.concat(F.lit("relation-"), (F.col("seq") - 1).cast("string")))
    return g.collapse_pairs(t, KEYS).select("source", "target", "w", "relation_type", "edge_key")


def parent_limit(spark, sf_dir):
    pairs = g.collapse_pairs(typed_edges(spark, sf_dir).withColumn("edge_key", F.col("seq")), KEYS)
    kept, excluded = g.limit_parents(pairs, KEYS, PARENTS)
    return kept.withColumn("reason", F.lit("kept")).unionByName(excluded).select("source", "target", "w", "reason")


def relation_dedup(spark, sf_dir):
    raw = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.lit("all").alias("doc"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("source"), F.concat(F.lit("L"), F.col("l_linestatus")).alias("target"), F.col("l_returnflag").alias("relation_type"),
        F.round(F.lit(1) - F.col("l_discount"), 4).alias("confidence"), F.array(F.concat(F.lit("FR-"), F.col("l_linenumber").cast("string"))).alias("source_frs"), F.array(F.concat(F.lit("q"), F.col("l_linenumber").cast("string"))).alias("supporting_excerpts"),
        F.concat(F.lit("line "), F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string")).alias("justification"), (F.col("l_tax") > 0.05).alias("cross_requirement"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"),
    )
    d = dedup_relations(raw, KEYS)
    return d.select("source", "target", "relation_type", "confidence", F.array_join("source_frs", ",").alias("source_frs"), "justification", "cross_requirement", F.col("seq").alias("first_seq"))


def _customers(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("doc"), F.col("c_custkey").alias("name"), "c_custkey", "c_mktsegment")


def _orders_as_relations(spark, sf_dir, where: str) -> DataFrame:
    """Urgent or filled orders as relations from their customer to the one 25 keys on, in the customer's nation."""
    o = table(spark, sf_dir, "orders").where(where).join(_customers(spark, sf_dir).select("doc", F.col("name").alias("o_custkey")), "o_custkey")
    return o.select("doc", F.col("o_custkey").alias("source"), (F.col("o_custkey") + 25).alias("target"), F.col("o_orderkey").alias("seq"))


def isolated_nodes(spark, sf_dir):
    alone = isolated(_customers(spark, sf_dir), _orders_as_relations(spark, sf_dir, "o_orderpriority = '1-URGENT'"), KEYS)
    return alone.groupBy(F.col("doc").alias("c_nationkey")).agg(F.count(F.lit(1)).alias("n_isolated"), F.min("c_custkey").alias("first_custkey"))


def semi_valid(spark, sf_dir):
    """Relations with both ends in the nation: how many, and the key of the first."""
    e = g.semantic_edges(_orders_as_relations(spark, sf_dir, "o_orderstatus = 'F'"), _customers(spark, sf_dir), KEYS)
    return e.groupBy("doc").agg(F.count(F.lit(1)).alias("n_edges"), F.min_by("edge_key", "seq").alias("first_key"), F.sum("source").alias("sum_sources"))


def cycle_cut(spark, sf_dir):
    """The trade graph with one edge against its order, of the least weight: the only cut that a search can make."""
    pairs = stage(g.collapse_pairs(typed_edges(spark, sf_dir).withColumn("edge_key", F.col("seq")), KEYS).select(*KEYS, "source", "target", "w", "seq"), "pairs")
    back = pairs.groupBy(*KEYS).agg(F.min_by(F.struct("source", "target"), "seq").alias("e")).select(*KEYS, F.col("e.target").alias("source"), F.col("e.source").alias("target"), F.lit(0.0).alias("w"), F.lit(0).alias("seq"))
    kept, excluded = g.remove_cycles(pairs.unionByName(back), KEYS)
    return kept.withColumn("reason", F.lit("kept")).unionByName(excluded.drop("removal")).select("source", "target", "w", "reason")


def reach_closure(spark, sf_dir):
    return g.closure(g.paths(_edges(spark, sf_dir), KEYS), KEYS).select("source", "target", F.col("shortest_path_length").cast("bigint").alias("shortest_path_length"), F.col("n_lengths").cast("bigint").alias("n_lengths"))


def shortest_path(spark, sf_dir):
    return _records(spark, sf_dir).select("source", "target", F.array_join("path", ">").alias("path"))


def dps_scores(spark, sf_dir):
    return _records(spark, sf_dir).select("source", "target", F.round("dps", 6).alias("dps"))


def path_support(spark, sf_dir):
    return _records(spark, sf_dir).select("source", "target", F.round("extraction_support", 6).alias("extraction_support"), F.array_join("strongest_support_path", ">").alias("strongest_support_path"))


def ranking_records(spark, sf_dir):
    return _shown(_records(spark, sf_dir))


def _ranked(strategy):
    def query(spark, sf_dir):
        return r.rank_records(_records(spark, sf_dir), strategy, KEYS, seed=7).select("source", "target", F.col("rank").cast("bigint").alias("rank"))

    return query


def budget_grid(spark, sf_dir):
    ranked = r.rank_records(_records(spark, sf_dir), "dps", KEYS)
    return r.budget_grid(ranked, BUDGETS).groupBy("nominal_budget").agg(F.count(F.lit(1)).alias("effective_budget"), F.round(F.sum("dps"), 6).alias("sum_dps"), F.round(F.min("dps"), 6).alias("least_dps"))


def precision_at_budget(spark, sf_dir):
    ranked = r.rank_records(_records(spark, sf_dir), "extraction_support", KEYS)
    # A pair counts as valid when the two names have lengths of equal parity.
    judged = ranked.select("doc", F.col("source").alias("source_element"), F.col("target").alias("target_element"), F.when((F.length("source") + F.length("target")) % 2 == 0, "YES").otherwise("NO").alias("evidence_decision"), F.lit("NO").alias("coverage_decision"), F.lit("YES").alias("boundary_decision"))
    p = r.precision_at_budget(r.budget_grid(ranked, BUDGETS), judged, KEYS, ["nominal_budget"])
    return p.select("nominal_budget", "effective_budget", "auto_valid_record_count", F.round("auto_valid_precision", 6).alias("auto_valid_precision"))


def cycle_removal(spark, sf_dir):
    """Moves between a user's consecutive event types: a small cyclic graph."""
    e = table(spark, sf_dir, "events").withColumn("next", F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("next IS NOT NULL AND next <> event_type")
    n = e.groupBy(F.col("event_type").alias("source"), F.col("next").alias("target")).agg(F.count(F.lit(1)).cast("double").alias("w")).withColumn("doc", F.lit("moves"))
    n = n.withColumn("seq", F.row_number().over(Window.partitionBy("doc").orderBy("source", "target"))).select("doc", "source", "target", "w", "seq")
    kept, excluded = g.remove_cycles(n, KEYS)
    return kept.withColumns({"removal": F.lit(0).cast("long"), "reason": F.lit("kept")}).unionByName(excluded).select("source", "target", "w", "removal", "reason")


QUERIES = {f.__name__: f for f in (pair_collapse, parent_limit, relation_dedup, isolated_nodes, semi_valid, cycle_cut, reach_closure, shortest_path, dps_scores, path_support, ranking_records, budget_grid, precision_at_budget, cycle_removal)}
QUERIES["flagship_dps_top20"] = flagship
QUERIES |= {f"rank_{s}": _ranked(s) for s in r.STRATEGIES}

_TYPED = """
n0 AS (SELECT s_nationkey, c_nationkey, o_orderpriority AS relation_type, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey < c_nationkey GROUP BY ALL),
t0 AS (SELECT a.n_name AS source, b.n_name AS target, relation_type, round(n / max(n) OVER (PARTITION BY c_nationkey), 6) AS confidence FROM n0 JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON c_nationkey = b.n_nationkey),
t AS (SELECT *, row_number() OVER (ORDER BY source, target, relation_type) AS seq FROM t0)"""
_PAIRS = (
    _TYPED
    + """,
p AS (SELECT source, target, confidence AS w, relation_type, 'relation-' || (seq - 1) AS edge_key FROM t QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY confidence DESC, relation_type, 'relation-' || (seq - 1)) = 1)"""
)
_EDGES = (
    _PAIRS
    + f""",
e AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY target ORDER BY w DESC, source) <= {PARENTS}),
d AS (SELECT target, count(*) AS indeg FROM e GROUP BY target)"""
)
_RECORDS = (
    _EDGES
    + """,
s AS (SELECT source, e.target, w / indeg AS share, ln(w) AS lw, relation_type FROM e JOIN d ON e.target = d.target),
h(source, target, hops, mass, ls, sp, fp) AS (
  SELECT source, target, 1, share, lw, [source, target], [source, target] FROM s
  UNION ALL
  SELECT h.source, s.target, h.hops + 1, sum(mass * share), arg_min(ls + lw, (-round(ls + lw, 12), list_append(sp, s.target))), arg_min(list_append(sp, s.target), (-round(ls + lw, 12), list_append(sp, s.target))), min(list_append(fp, s.target))
  FROM h JOIN s ON h.target = s.source GROUP BY h.source, s.target, h.hops),
k AS (SELECT source, target, least(sum(mass), 1.0) AS dps, max(exp(ls / hops)) AS extraction_support, min(hops) AS shortest_path_length, arg_min(fp, hops) AS path,
  arg_min(sp, (-round(exp(ls / hops), 12), sp)) AS strongest FROM h GROUP BY source, target),
legs AS (SELECT source, target, path[i] AS a, path[i + 1] AS b FROM (SELECT *, unnest(range(1, len(path))) AS i FROM k)),
y AS (SELECT legs.source, legs.target, array_to_string(list_sort(list_distinct(list(relation_type))), '|') AS relation_types FROM legs JOIN e ON a = e.source AND b = e.target GROUP BY ALL)"""
)
_ORDERS = "r AS (SELECT c_nationkey AS doc, o_custkey AS source, o_custkey + 25 AS target, o_orderkey AS seq FROM orders JOIN customer ON o_custkey = c_custkey WHERE {where})"
_R = f"WITH RECURSIVE {_RECORDS} "
_ALL = """k.source, k.target, round(dps, 6) AS dps, round(extraction_support, 6) AS extraction_support, CAST(shortest_path_length AS BIGINT) AS shortest_path_length, array_to_string(path, '>') AS path,
 relation_types, 'record-' || sha256(k.source || '||' || k.target)[1:16] AS record_id"""
_JOINED = "FROM k JOIN y ON k.source = y.source AND k.target = y.target"
_ORDER = {"dps": "round(dps, 12) DESC, source, target", "extraction_support": "round(extraction_support, 12) DESC, source, target", "topology": "shortest_path_length, source, target", "unranked": "source, target"}

SQL = {
    "pair_collapse": f"WITH {_PAIRS} SELECT * FROM p",
    "parent_limit": f"WITH {_PAIRS} SELECT source, target, w, CASE WHEN row_number() OVER (PARTITION BY target ORDER BY w DESC, source) <= {PARENTS} THEN 'kept' ELSE 'parent_limit' END AS reason FROM p",
    "relation_dedup": """
WITH x AS (SELECT 'N' || s_nationkey AS source, 'L' || l_linestatus AS target, l_returnflag AS relation_type, round(1 - l_discount, 4) AS confidence, 'FR-' || l_linenumber AS fr,
  'line ' || l_orderkey || '.' || l_linenumber AS justification, l_tax > 0.05 AS cr, l_orderkey * 100 + l_linenumber AS seq FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
SELECT source, target, relation_type, max(confidence) AS confidence, (SELECT string_agg(fr, ',' ORDER BY f) FROM (SELECT fr, min(seq) AS f FROM x y WHERE y.source = x.source AND y.target = x.target AND y.relation_type = x.relation_type GROUP BY fr)) AS source_frs, arg_min(justification, (-confidence, seq)) AS justification, bool_or(cr) AS cross_requirement, min(seq) AS first_seq FROM x GROUP BY source, target, relation_type""",
    "isolated_nodes": f"""WITH {_ORDERS.format(where="o_orderpriority = '1-URGENT'")}
SELECT c_nationkey, count(*) AS n_isolated, min(c_custkey) AS first_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc = c_nationkey AND (source = c_custkey OR target = c_custkey)) GROUP BY c_nationkey""",
    "semi_valid": f"""WITH {_ORDERS.format(where="o_orderstatus = 'F'")}, k AS (SELECT *, 'relation-' || (row_number() OVER (PARTITION BY doc ORDER BY seq) - 1) AS edge_key FROM r)
SELECT doc, count(*) AS n_edges, arg_min(edge_key, seq) AS first_key, CAST(sum(source) AS BIGINT) AS sum_sources FROM k WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = doc AND c_custkey = target) GROUP BY doc""",
    "cycle_cut": f"""WITH {_TYPED}, p AS (SELECT source, target, confidence AS w, seq FROM t QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY confidence DESC, relation_type, CAST(seq AS VARCHAR)) = 1)
SELECT source, target, w, 'kept' AS reason FROM p UNION ALL SELECT target, source, 0.0::DOUBLE, 'cycle_removal' FROM (SELECT * FROM p ORDER BY seq LIMIT 1)""",
    "reach_closure": _R + "SELECT source, target, CAST(min(hops) AS BIGINT) AS shortest_path_length, count(*) AS n_lengths FROM h GROUP BY source, target",
    "shortest_path": _R + "SELECT source, target, array_to_string(path, '>') AS path FROM k",
    "dps_scores": _R + "SELECT source, target, round(dps, 6) AS dps FROM k",
    "path_support": _R + "SELECT source, target, round(extraction_support, 6) AS extraction_support, array_to_string(strongest, '>') AS strongest_support_path FROM k",
    "ranking_records": _R + f"SELECT {_ALL} {_JOINED}",
    "flagship_dps_top20": _R + f"SELECT {_ALL}, CAST(row_number() OVER (ORDER BY round(dps, 12) DESC, k.source, k.target) AS INT) AS rank {_JOINED} QUALIFY rank <= 20",
    "budget_grid": _R + f", z AS (SELECT *, row_number() OVER (ORDER BY {_ORDER['dps']}) AS rk FROM k) SELECT b AS nominal_budget, count(*) AS effective_budget, round(sum(dps), 6) AS sum_dps, round(min(dps), 6) AS least_dps FROM z JOIN (SELECT unnest([5, 10, 15, 20]) AS b) ON rk <= b GROUP BY b",
    "precision_at_budget": _R
    + f""", z AS (SELECT *, row_number() OVER (ORDER BY {_ORDER["extraction_support"]}) AS rk FROM k)
SELECT b AS nominal_budget, count(*) AS effective_budget, count(*) FILTER ((length(source) + length(target)) % 2 = 0) AS auto_valid_record_count, round(count(*) FILTER ((length(source) + length(target)) % 2 = 0) / count(*), 6) AS auto_valid_precision
FROM z JOIN (SELECT unnest([5, 10, 15, 20]) AS b) ON rk <= b GROUP BY b""",
}
SQL |= {f"rank_{s}": _R + f"SELECT source, target, row_number() OVER (ORDER BY {o}) AS rank FROM k" for s, o in _ORDER.items()}
