"""Documents to requirement blocks, and text windows around blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specweave.functions.scalars import strip
from specweave.functions.segmentation import longest_split, marked, numbered, requirements_scope, split_columns


def blocks(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """A row per block: keys, seq (from 0), requirement_id, block.

    The split with the most blocks wins; without one the text is cut at blank lines. Each step is a projection of
    its own, so no split is computed twice.
    """
    scoped = docs.select(*keys, strip(requirements_scope(F.coalesce(F.col(text), F.lit("")))).alias("_scope"))
    split = scoped.select(*keys, *(c.alias(n) for n, c in split_columns(F.col("_scope")).items()))
    chosen = split.select(*keys, longest_split().alias("_parts"))
    named = chosen.select(*keys, marked(F.col("_parts")).alias("_marked"))
    return named.select(*keys, F.inline(numbered(F.col("_marked"))))


def line_blocks(lines: DataFrame, keys: list[str], order: str, line: str, opens: str) -> DataFrame:
    """Blocks of a line table: a line with ``opens`` true starts one; lines before the first are block 0."""
    along = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.withColumn("block_no", F.sum(F.col(opens).cast("int")).over(along))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda s: s[line]), "\n")
    return numbered.groupBy(*keys, "block_no").agg(F.count(F.lit(1)).alias("n_lines"), text.alias("block"))


def scope_lines(lines: DataFrame, keys: list[str], order: str, heading: str, wanted: str) -> DataFrame:
    """Lines from the first wanted heading up to the next heading; all lines where no heading is wanted."""
    along = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    part = lines.withColumn("section", F.sum(F.col(heading).cast("int")).over(along))
    part = part.withColumn("chosen", F.min(F.when(F.col(heading) & F.col(wanted), F.col("section"))).over(whole))
    return part.where(F.col("chosen").isNull() | (F.col("section") == F.col("chosen"))).drop("section", "chosen")


def context(requests: DataFrame, blocks_: DataFrame, docs: DataFrame, keys: list[str], ids: str = "requirement_ids", text: str = "text") -> DataFrame:
    """requests with ``context``: the blocks with the wanted ids (all, if none are wanted) by blank line, else the whole text."""
    asked = requests.select(*keys, ids).distinct()
    hit = asked.join(blocks_.select(*keys, "seq", "requirement_id", "block"), keys).where((F.size(ids) == 0) | F.array_contains(F.col(ids), F.col("requirement_id")))
    joined = hit.groupBy(*keys, ids).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "block"))), lambda s: s["block"]), "\n\n").alias("_found"))
    return requests.join(joined, [*keys, ids], "left").join(docs.select(*keys, F.col(text).alias("_whole")), keys, "left").withColumn("context", F.coalesce("_found", "_whole")).drop("_found", "_whole")
