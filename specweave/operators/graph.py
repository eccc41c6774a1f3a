"""The computational graph: one edge per pair, no cycles, few parents; propagation over paths by hops.

Edges are keys, source, target, w, relation_type. All path quantities come from one frontier that advances a hop
at a time, one row per (source, node) and hop, so paths are never enumerated. With activations affine in the
clamped source and weights at most 1, the effect of a source on a target is the sum over paths of the product
of w / in-degree; in-degrees count all parents.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specweave.functions.scalars import stable_id
from specweave.storage import small, stage

MAX_PARENTS = 12
#: Edges that are broadcast in a hop at most.
MAX_BROADCAST = 100_000


def semantic_edges(relations: DataFrame, elements: DataFrame, keys: list[str]) -> DataFrame:
    """Relations with both ends among the elements; edge_key is ``relation-n`` by position."""
    names = elements.select(*keys, "name").distinct()
    ends = lambda side: names.withColumnRenamed("name", side)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("seq")) - 1
    return relations.withColumn("edge_key", F.concat(F.lit("relation-"), place.cast("string"))).join(ends("source"), [*keys, "source"], "left_semi").join(ends("target"), [*keys, "target"], "left_semi")


def collapse_pairs(relations: DataFrame, keys: list[str]) -> DataFrame:
    """The best relation of each pair: highest confidence, then type, then key as text."""
    order = Window.partitionBy(*keys, "source", "target").orderBy(F.desc("confidence"), "relation_type", F.col("edge_key").cast("string"))
    best = relations.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return best.select(*keys, "source", "target", F.col("confidence").alias("w"), "relation_type", "edge_key", "seq")


def limit_parents(edges: DataFrame, keys: list[str], most: int = MAX_PARENTS) -> tuple[DataFrame, DataFrame]:
    """(kept, excluded): per target the heaviest ``most`` edges, ties by source name."""
    order = Window.partitionBy(*keys, "target").orderBy(F.desc("w"), "source")
    ranked = edges.withColumn("_n", F.row_number().over(order))
    return ranked.where(F.col("_n") <= most).drop("_n"), ranked.where(F.col("_n") > most).drop("_n").withColumn("reason", F.lit("parent_limit"))


def _cycle(nodes: list, out: dict) -> list[tuple] | None:
    """The first cycle that a depth-first search closes, nodes and edges in their given order."""
    state: dict = {}
    for root in nodes:
        if state.get(root):
            continue
        path, steps = [root], [iter(out.get(root, ()))]
        state[root] = 1
        while path:
            for child in steps[-1]:
                if state.get(child) == 1:
                    ring = path[path.index(child) :] + [child]
                    return list(zip(ring, ring[1:], strict=False))
                if not state.get(child):
                    state[child] = 1
                    path.append(child)
                    steps.append(iter(out.get(child, ())))
                    break
            else:
                state[path.pop()] = 2
                steps.pop()
    return None


def mark_cycles(edges: pd.DataFrame, names: list | None = None) -> pd.Series:
    """For the edges of one graph: the order in which cycle removal drops each, 0 if it stays."""
    edges = edges.reset_index(drop=True)
    place = {(s, t): i for i, (s, t) in enumerate(zip(edges["source"], edges["target"], strict=True))}
    nodes = names if names is not None else sorted({*edges["source"], *edges["target"]}, key=lambda x: (x.lower(), x))
    # Successors come in the order in which their edges were added, sources in node order.
    rank = {n: i for i, n in enumerate(nodes)}
    order = sorted(range(len(edges)), key=lambda i: (rank[edges["source"][i]], edges["seq"][i]))
    out: dict = {}
    for i in order:
        out.setdefault(edges["source"][i], []).append(edges["target"][i])
    dropped = pd.Series(0, edges.index)
    n = 0
    while ring := _cycle(nodes, out):
        s, t = min(ring, key=lambda e: (edges["w"][place[e]], *e))
        out[s].remove(t)
        n += 1
        dropped[place[s, t]] = n
    return dropped


def remove_cycles(edges: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, excluded): per graph, repeatedly drop the least (w, source, target) edge of a found cycle.

    A graph belongs to one document, so a group is one document's edges.
    """

    def drop(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(_dropped=mark_cycles(pdf).to_numpy())

    marked = stage(edges.groupBy(*keys).applyInPandas(drop, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in edges.schema)}, _dropped long"), "graph-cycles")
    return marked.where("_dropped = 0").drop("_dropped"), marked.where("_dropped > 0").withColumnRenamed("_dropped", "removal").withColumn("reason", F.lit("cycle_removal"))


def paths(edges: DataFrame, keys: list[str], max_hops: int = 10_000) -> DataFrame:
    """Per hop count: keys, source, target, hops, mass, log_support, support_path, first_path.

    mass: sum over paths of that length; log_support and support_path: the strongest such path (ties within
    1e-12 to the lesser path); first_path: the lexicographically least. Raises on a cyclic graph.
    """
    degree = edges.groupBy(*keys, "target").agg(F.count(F.lit(1)).alias("_in"))
    w = F.least(F.col("w"), F.lit(1.0))
    step = stage(edges.join(degree, [*keys, "target"]).select(*keys, F.col("source").alias("node"), F.col("target").alias("next"), (F.col("w") / F.col("_in")).alias("share"), F.when(w > 0, F.ln(w)).alias("log_w")), "graph-step")
    near = small(step, MAX_BROADCAST)
    start = F.array("node", "next")
    frontier = step.select(*keys, F.col("node").alias("source"), F.col("next").alias("target"), F.col("share").alias("mass"), F.col("log_w").alias("log_support"), F.when(F.col("log_w").isNotNull(), start).alias("support_path"), start.alias("first_path"))
    hops, hop = None, 1
    while True:
        frontier = stage(frontier, "graph-hop")
        if frontier.isEmpty():
            break
        if hop > max_hops or not frontier.where("source = target").isEmpty():
            raise ValueError("the graph has a cycle")
        here = frontier.withColumn("hops", F.lit(hop))
        hops = here if hops is None else hops.unionByName(here)
        ahead = frontier.withColumnRenamed("target", "node").join(near, [*keys, "node"])
        total = F.col("log_support") + F.col("log_w")
        grown = ahead.select(*keys, "source", F.col("next").alias("target"), (F.col("mass") * F.col("share")).alias("mass"), total.alias("log_support"), F.when(total.isNotNull(), F.concat("support_path", F.array("next"))).alias("support_path"), F.concat("first_path", F.array("next")).alias("first_path"))
        rank = F.when(F.col("log_support").isNotNull(), F.struct((-F.round("log_support", 12)).alias("s"), F.col("support_path").alias("p")))
        frontier = grown.groupBy(*keys, "source", "target").agg(
            F.sum("mass").alias("mass"), F.min_by("log_support", rank).alias("log_support"), F.min_by("support_path", rank).alias("support_path"), F.min("first_path").alias("first_path")
        )
        hop += 1
    return hops if hops is not None else frontier.withColumn("hops", F.lit(0))


def closure(hops: DataFrame, keys: list[str]) -> DataFrame:
    return hops.groupBy(*keys, "source", "target").agg(F.min("hops").alias("shortest_path_length"), F.sum(F.lit(1)).alias("n_lengths"))


def ranking_records(hops: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Every reachable pair with its three signals, shortest path, relation types along it, strongest path."""
    support = F.round(F.exp(F.col("log_support") / F.col("hops")), 12)
    strongest = F.when(F.col("support_path").isNotNull(), F.struct((-support).alias("s"), F.col("support_path").alias("p")))
    pairs = hops.groupBy(*keys, "source", "target").agg(
        F.greatest(F.least(F.sum("mass"), F.lit(1.0)), F.lit(0.0)).alias("dps"),
        F.coalesce(F.least(F.max(F.exp(F.col("log_support") / F.col("hops"))), F.lit(1.0)), F.lit(0.0)).alias("extraction_support"),
        F.min("hops").alias("shortest_path_length"), F.min_by("first_path", "hops").alias("path"),
        F.coalesce(F.min_by("support_path", strongest), F.array().cast("array<string>")).alias("strongest_support_path"),
    )
    legs = pairs.select(*keys, "source", "target", F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("i", "_a"), "path").withColumn("_b", F.element_at("path", F.col("i") + 2)).drop("path", "i")
    types = edges.select(*keys, F.col("source").alias("_a"), F.col("target").alias("_b"), "relation_type")
    typed = legs.join(types, [*keys, "_a", "_b"]).groupBy(*keys, "source", "target").agg(F.array_sort(F.collect_set("relation_type")).alias("relation_types"))
    return pairs.join(typed, [*keys, "source", "target"], "left").withColumn("record_id", stable_id("record", F.col("source"), F.col("target")))


def build(elements: DataFrame, relations: DataFrame, keys: list[str], max_parents: int = MAX_PARENTS) -> tuple[DataFrame, DataFrame]:
    """(edges of the acyclic graph, excluded edges with their reason)."""
    pairs = collapse_pairs(semantic_edges(relations, elements, keys), keys)
    acyclic, cycles = remove_cycles(pairs, keys)
    kept, crowded = limit_parents(acyclic, keys, max_parents)
    return kept, cycles.drop("removal").unionByName(crowded)
