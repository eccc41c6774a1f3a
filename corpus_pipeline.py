"""A training-data pipeline over ``documents``: quality, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last
return the columns of documents. run() writes each result as Parquet in the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specweave.llm.common import documents, stage, whole_text
from specweave.llm.line_dedup import dedup_lines
from specweave.llm.mix_sources import mix_sources
from specweave.llm.near_dedup import near_duplicates
from specweave.llm.packing import pack
from specweave.llm.quality_classifier import classify, train


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier does not reject."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classify(docs, model).where("kept").select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line resembles; those that lose all their words go."""
    done = dedup_lines(docs)
    return done.where((F.col("n_removed") == 0) | whole_text().rlike(r"[^\x20\x09-\x0D]")).select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_duplicates(docs).where("keep").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a repeat is a row of its own."""
    return mix_sources(docs).where("copies > 0").select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).drop("_copy")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and place in it."""
    return pack(docs).drop("row")


STAGES = [("quality classifier", quality), ("line dedup", lines), ("near-duplicates", near), ("mixing", mix), ("packing", packed)]

#: Hash tokenisers, trained models and alignment have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
