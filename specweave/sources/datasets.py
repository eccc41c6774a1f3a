"""Document datasets: JSON arrays of {system_id, document_id, text}, sharding, audit tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specweave.storage import small, stage

REQUIRED = ("system_id", "document_id", "text")


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """system_id, document_id, text, pos of a JSON array (a byte order mark is skipped, other keys ignored).

    Raises ValueError naming the 1-based item if the file is no array, an item no object, or a key is missing.
    """
    whole = spark.read.text(path, wholetext=True).select(F.try_parse_json(F.regexp_replace("value", "^\\uFEFF", "")).alias("v"))
    kind = F.regexp_extract(F.schema_of_variant("v"), r"^[A-Z]+", 0)
    if whole.where(F.coalesce(kind, F.lit("")) != "ARRAY").limit(1).count():
        raise ValueError(f"{path}: the dataset must be a JSON array")
    items = whole.select(F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("pos", "item"))
    found = items.select(F.col("pos").cast("long").alias("pos"), F.regexp_extract(F.schema_of_variant("item"), r"^[A-Z]+", 0).alias("_kind"), *(F.try_variant_get("item", f"$.{k}", "string").alias(k) for k in REQUIRED), *(F.try_variant_get("item", f"$.{k}", "variant").isNull().alias(f"_no_{k}") for k in REQUIRED))
    bad = found.where((F.coalesce("_kind", F.lit("")) != "OBJECT") | F.col("_no_system_id") | F.col("_no_document_id") | F.col("_no_text")).orderBy("pos").limit(1).collect()
    if bad:
        missing = [k for k in REQUIRED if bad[0][f"_no_{k}"]]
        raise ValueError(f"item {bad[0]['pos'] + 1}: " + (f"missing {', '.join(missing)}" if bad[0]["_kind"] == "OBJECT" else "not an object"))
    return found.select(*(F.coalesce(k, F.lit("None")).alias(k) for k in REQUIRED), "pos")


def parse_shard(spec: str) -> tuple[int, int]:
    """(index, count) of ``I/N`` with 0 <= I < N."""
    m = re.fullmatch(r"\s*(\d+)\s*/\s*(\d+)\s*", spec)
    if not m or int(m[2]) < 1 or int(m[1]) >= int(m[2]):
        raise ValueError(f"shard must be I/N with 0 <= I < N, got {spec!r}")
    return int(m[1]), int(m[2])


def with_positions(df: DataFrame, *order, pos: str = "pos") -> DataFrame:
    """df with the position (from 0) of each row in the order: a distributed sort and one offset per task."""
    sorted_ = stage(df.orderBy(*order).select("*", F.spark_partition_id().alias("_task"), F.monotonically_increasing_id().alias("_id")), "positions")
    counts = sorted_.groupBy("_task").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_task", (F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))  # a row per task
    return sorted_.join(small(before), "_task").withColumn(pos, F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_task", "_id", "_before")


def shard(docs: DataFrame, spec: str | None, pos: str = "pos") -> DataFrame:
    """Rows whose position leaves the shard's remainder; all rows without a spec."""
    if not spec:
        return docs
    i, n = parse_shard(spec)
    return docs.where(F.pmod(F.col(pos), F.lit(n)) == i)


def audit_counts(rows: DataFrame, name: str, count: str) -> DataFrame:
    """document_id, fr_count of audit rows whose name ends in .docx and whose count is digits; the last row wins."""
    stem, digits = F.regexp_replace(F.trim(F.col(name)), r"(?i)\.docx$", ""), F.trim(F.col(count).cast("string"))
    kept = rows.where(F.lower(F.trim(F.col(name))).endswith(".docx") & digits.rlike(r"^\d+$"))
    return kept.groupBy(stem.alias("document_id")).agg(F.max_by(digits.cast("int"), "pos").alias("fr_count"))


def compare_counts(counted: DataFrame, audit: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """counted (document_id, n) against the audit: status match, unrecorded, known_error or mismatch."""
    joined = counted.join(audit, "document_id", "left")
    if known is not None:
        joined = joined.join(small(known.select("document_id", F.col("fr_count").alias("_right"))), "document_id", "left")
    else:
        joined = joined.withColumn("_right", F.lit(None).cast("int"))
    status = F.when(F.col("fr_count").isNull(), "unrecorded").when(F.col("n") == F.col("fr_count"), "match").when(F.col("n") == F.col("_right"), "known_error").otherwise("mismatch")
    return joined.withColumn("status", status).drop("_right")


def project_of(path: Column) -> Column:
    """Project of a corpus file: its folder, or the folder above one named ``document``."""
    folder, above = F.element_at(F.split(path, "/"), -2), F.element_at(F.split(path, "/"), -3)
    return F.when(F.lower(folder) == "document", above).otherwise(folder)
