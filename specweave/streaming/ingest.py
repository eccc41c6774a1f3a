"""Incremental ingestion (an extension): new documents are segmented as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from specweave.operators.segments import blocks


def document_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """JSON-lines files of documents that land in a folder, as a stream."""
    return spark.readStream.schema("system_id string, document_id string, text string").option("maxFilesPerTrigger", max_files).json(path)


def segment_stream(docs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Blocks of each new document appended to ``out``; documents are independent, so no state is kept."""
    cut = blocks(docs, ["system_id", "document_id"])
    return cut.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
