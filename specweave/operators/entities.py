"""Typed elements and relations: filters, alias resolution, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specweave.functions.scalars import ELEMENT_TYPES, RELATION_TYPES, strip

LEAST_CONFIDENCE, LEAST_CROSS_CONFIDENCE = 0.75, 0.60


def first_best(value: Column, seq: str = "seq") -> Column:
    """The value at the highest confidence, the earliest on ties (max_by would take the last)."""
    return F.min_by(value, F.struct((-F.col("confidence")).alias("c"), F.col(seq).alias("s")))


def with_unions(rows: DataFrame, group: list[str], merged: DataFrame, arrays: tuple[str, ...], seq: str = "seq") -> DataFrame:
    """merged (a row per group) with the ordered distinct union of each array column over its group.

    Each value is first reduced to its earliest place, so a group gathers its distinct values only, not its rows.
    """
    empty = F.array().cast("array<string>")
    tag = lambda k: lambda x, i: F.struct(F.lit(k).alias("k"), i.alias("p"), strip(x).alias("v"))
    tagged = [F.transform(F.coalesce(F.col(a), empty), tag(k)) for k, a in enumerate(arrays)]
    each = rows.select(*group, F.col(seq).alias("_s"), F.explode(F.concat(*tagged)).alias("_x")).where("_x.v <> ''")
    first = each.groupBy(*group, F.col("_x.k").alias("_k"), F.col("_x.v").alias("_v")).agg(F.min(F.struct("_s", "_x.p")).alias("_at"))
    listed = first.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_at", "_k", "_v"))).alias("_all"))
    own = [f"_g{i}" for i in range(len(group))]
    same = [F.col(c).eqNullSafe(F.col(o)) for c, o in zip(group, own, strict=True)]
    joined = merged.join(listed.withColumnsRenamed(dict(zip(group, own, strict=True))), same, "left")
    of = lambda k: F.coalesce(F.transform(F.filter("_all", lambda x: x["_k"] == k), lambda x: x["_v"]), empty)
    return joined.withColumns({a: of(k) for k, a in enumerate(arrays)}).drop("_all", *own)


def merge_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(strip(name)), r"(?U)\s+", " ")


def valid_elements(elements: DataFrame) -> DataFrame:
    excerpt = F.try_element_at(F.col("supporting_excerpts"), F.lit(1))
    return elements.where(F.upper("element_type").isin(*ELEMENT_TYPES) & (F.col("confidence") >= LEAST_CONFIDENCE) & (F.col("name") != "") & (F.coalesce(excerpt, F.lit("")) != ""))


def merge_elements(elements: DataFrame, keys: list[str]) -> DataFrame:
    """One row per normalised name and type; seq numbers the result by lower-cased name, ties in first-seen order."""
    elements, group = elements.withColumn("_key", merge_key(F.col("name"))), [*keys, "_key", "element_type"]
    merged = elements.groupBy(*group).agg(first_best(F.col("name")).alias("name"), F.max("confidence").alias("confidence"), first_best(F.col("description")).alias("description"), F.min("seq").alias("_first"))
    merged = with_unions(elements, group, merged, ("source_frs", "supporting_excerpts", "aliases"))
    order = Window.partitionBy(*keys).orderBy(F.lower("name"), "_first")
    return merged.withColumn("seq", F.row_number().over(order)).drop("_key", "_first")


def alias_map(elements: DataFrame, keys: list[str]) -> DataFrame:
    """keys, alias (lower case), name: names and aliases in element order, the last writer wins."""
    names = elements.select(*keys, "seq", F.posexplode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("place", "alias"), "name")
    last = F.max_by("name", F.struct("seq", "place"))
    return names.groupBy(*keys, F.lower("alias").alias("alias")).agg(last.alias("name"))


def valid_relations(relations: DataFrame, aliases: DataFrame, keys: list[str], cross: bool) -> DataFrame:
    """Relations whose ends resolve to two different elements, of a known type, confident enough, with an excerpt."""
    ends = lambda side: aliases.select(*keys, F.col("alias").alias(f"_{side}"), F.col("name").alias(f"_{side}_name"))
    least = LEAST_CROSS_CONFIDENCE if cross else LEAST_CONFIDENCE
    named = relations.withColumns({"_source": F.lower(strip(F.col("source"))), "_target": F.lower(strip(F.col("target"))), "relation_type": F.upper(strip(F.col("relation_type")))})
    named = named.where(F.col("relation_type").isin(*RELATION_TYPES) & (F.col("confidence") >= least) & (F.size("supporting_excerpts") > 0))
    found = named.join(ends("source"), [*keys, "_source"]).join(ends("target"), [*keys, "_target"]).where("_source_name <> _target_name")
    return found.withColumns({"source": F.col("_source_name"), "target": F.col("_target_name"), "cross_requirement": F.lit(cross)}).drop("_source", "_target", "_source_name", "_target_name")


def dedup_relations(relations: DataFrame, keys: list[str]) -> DataFrame:
    """One row per (source, target, type), in first-seen order."""
    group = [*keys, "source", "target", "relation_type"]
    merged = relations.groupBy(*group).agg(F.max("confidence").alias("confidence"), first_best(F.col("justification")).alias("justification"), F.bool_or("cross_requirement").alias("cross_requirement"), F.min("seq").alias("seq"))
    return with_unions(relations, group, merged, ("source_frs", "supporting_excerpts")).select(*group, "confidence", "source_frs", "supporting_excerpts", "justification", "cross_requirement", "seq")


def isolated(elements: DataFrame, relations: DataFrame, keys: list[str]) -> DataFrame:
    """Elements that no relation touches."""
    ends = relations.select(*keys, F.explode(F.array("source", "target")).alias("name"))
    return elements.join(ends, [*keys, "name"], "left_anti")
