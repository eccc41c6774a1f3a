"""Connected components of a link table by repeated joins; nothing is gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specweave.llm.common import stage


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links(a long, b long); label is the least node of its component.

    Each round takes the least label among neighbours, then that label's own label (pointer jumping), so long
    chains shrink in a logarithmic number of rounds. Rounds are written to the shared folder.
    """
    both = stage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "cc-edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "cc-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        least = stage(labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label")), "cc-near")
        jumped = least.join(least.select(F.col("node").alias("label"), F.col("label").alias("further")), "label", "left")
        jumped = stage(jumped.select("node", "was", F.coalesce("further", "label").alias("label")), "cc-jump")
        if jumped.where("was <> label").limit(1).count() == 0:
            return jumped.select("node", "label")
        labels = jumped.select("node", "label")
