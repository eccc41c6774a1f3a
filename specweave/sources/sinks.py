"""Writers: nested run records, dataset files, one text file per artefact."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stem(system_id: str = "system_id", document_id: str = "document_id", run_id: str = "run_id") -> Column:
    return F.concat(F.col(system_id), F.lit("_"), F.col(document_id), F.lit("_run"), F.col(run_id).cast("string"))


def append_runs(df: DataFrame, path: str, by: str = "document_id") -> None:
    """Add finished runs as Parquet, partitioned; nothing written before is rewritten."""
    df.write.mode("append").partitionBy(by).parquet(path)


def write_dataset(docs: DataFrame, path: str) -> None:
    """JSON lines of system_id, document_id, text; Spark's part files in place of one array."""
    docs.select("system_id", "document_id", "text").write.mode("overwrite").json(path)


def nested(rows: DataFrame, keys: list[str], name: str, order: str = "seq") -> DataFrame:
    """Rows of a run as one array column, in order: the nested form of a run's record."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *(c for c in rest if c != order)))).alias(name))


def write_artefacts(docs: DataFrame, folder: str, suffix: str) -> None:
    """A UTF-8 file stem + suffix per row of (keys, body), written by the executors to a folder that all share."""

    def put(rows) -> None:
        Path(folder).mkdir(parents=True, exist_ok=True)
        for r in rows:
            (Path(folder) / f"{r['stem']}{suffix}").write_text(r["body"], encoding="utf-8")

    docs.select(stem().alias("stem"), "body").foreachPartition(put)
