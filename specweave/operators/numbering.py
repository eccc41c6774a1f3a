"""Continuing a document's own numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specweave.functions.numbering import classify_id, dialect_of_text, format_number, major_of, number_of


def numbering_context(docs: DataFrame, blocks: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, dialect, major, last, prefix, marker of every document.

    The dialect is the one most identifiers have, the first seen on ties; dotted identifiers under Markdown
    headings are ``mddot``. Documents without identifiers are judged by their text. The compound prefix is that
    of the last compound identifier, the last number is the highest over all of them.
    """
    named = blocks.withColumn("dialect", F.when(~F.startswith("requirement_id", F.lit("BLOCK-")), classify_id(F.col("requirement_id"))))
    votes = named.where("dialect IS NOT NULL").groupBy(*keys, "dialect").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    winner = votes.groupBy(*keys).agg(F.min_by("dialect", F.struct((-F.col("n")).alias("n"), "first")).alias("_vote"))
    heading, prefix = F.regexp_extract("block", r"(?U)^(#{1,6})\s*\S", 1), F.upper(F.regexp_extract("requirement_id", r"(?Ui)^(FR-[A-Z]{1,6})-\d+\z", 1))
    major = major_of(F.col("requirement_id"))
    per = blocks.groupBy(*keys).agg(
        F.min_by(heading, F.when(heading != "", F.col("seq"))).alias("_marker"), F.min_by(major, F.when(major.isNotNull(), F.col("seq"))).alias("_major"), F.max_by(prefix, F.when(prefix != "", F.col("seq"))).alias("_prefix")
    )
    base = docs.select(*keys, dialect_of_text(F.coalesce(F.col(text), F.lit(""))).alias("_text")).join(winner, keys, "left").join(per, keys, "left")
    empty = lambda c: F.coalesce(c, F.lit(""))
    base = base.withColumns({"marker": empty(F.col("_marker")), "major": empty(F.col("_major"))})
    base = base.withColumn("dialect", F.when((F.col("_vote") == "dot") & (F.col("marker") != ""), "mddot").otherwise(F.coalesce("_vote", "_text")))
    base = base.withColumn("prefix", F.when(F.col("dialect") == "compound", empty(F.col("_prefix"))).otherwise(""))
    last = blocks.join(base.select(*keys, "major"), keys).groupBy(*keys).agg(F.max(number_of(F.col("requirement_id"), F.col("major"))).alias("_last"))
    return base.join(last, keys, "left").select(*keys, "dialect", "major", F.coalesce("_last", F.lit(0)).cast("long").alias("last"), "prefix", "marker")


def assign_numbers(candidates: DataFrame, context: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """candidates with fr_number, continuing the document's sequence in the given order."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    number = F.col("last") + F.col("_nth")
    return candidates.withColumn("_nth", nth).join(context, keys).withColumn("fr_number", format_number(F.col("dialect"), F.col("major"), number, F.col("prefix"))).drop("_nth", "dialect", "major", "last", "prefix", "marker")
