"""Shared plumbing of the corpus operators: shared folder, written stages, word rules."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Fixed value: white space that separates words where a contract says ``[^\x20\x09-\x0D]+``.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local one only where that is unset and all runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="specweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Rows of an Arrow batch while stages are made: whole texts of so many rows are held by both sides at once.
BATCH_ROWS = 1000
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of BATCH_ROWS at most for what runs inside."""
    before = spark.conf.get(_BATCH_KEY)
    if not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(_BATCH_KEY, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_KEY, before)


def give_back() -> None:
    """Return freed memory to the system. What the first call finds, mostly modules, is not searched again by later ones."""
    gc.collect()
    if not gc.get_freeze_count():
        gc.freeze()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries lack it
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run: Callable) -> Callable:
    """run (batches to batches), giving back the memory that it no longer uses when a task ends, as workers stay."""

    @functools.wraps(run)
    def trimming(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return trimming


def stage(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_text(column: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small(df: DataFrame, limit: int) -> DataFrame:
    """Broadcast df only when it has at most ``limit`` rows; beyond that the planner joins by shuffle."""
    return F.broadcast(df) if len(df.limit(limit + 1).select(F.lit(1)).collect()) <= limit else df


def append(docs: DataFrame, columns: str, compute, text_col: str = "text", keep: bool = True) -> DataFrame:
    """docs with columns computed from whole texts in Arrow batches.

    columns: their DDL; those that docs has already are replaced. compute: called once per task, gives a
    function from a list of texts (null: empty) to a list of column values. keep=False drops the text.
    """
    added = T.StructType.fromDDL(columns)
    kept = [c for c in docs.columns if c not in added.names or c == text_col]
    schema = T.StructType([docs.schema[c] for c in kept if keep or c != text_col] + added.fields)
    at, n = kept.index(text_col), len(added)
    arrow = to_arrow_schema(schema)

    @trimmed
    def run(batches):
        f = compute()
        for batch in batches:
            values = f(["" if x is None else x for x in batch.column(at).to_pylist()])
            before = [c for i, c in enumerate(batch.columns) if keep or i != at]
            yield pa.RecordBatch.from_arrays(before + [pa.array(v, arrow.field(len(before) + i).type) for i, v in zip(range(n), values, strict=True)], names=schema.names)

    return docs.select(*kept).mapInArrow(run, schema)


def squeezed(df: DataFrame, column: str = "text") -> DataFrame:
    """df with a text column as Zstandard frames, a third of what a shuffle makes of texts; null stays null."""
    at = df.columns.index(column)
    schema = T.StructType([T.StructField(column, T.BinaryType()) if i == at else f for i, f in enumerate(df.schema.fields)])

    @trimmed
    def run(batches):
        tool = zstandard.ZstdCompressor(3)
        for batch in batches:
            columns = batch.columns
            columns[at] = pa.array([None if x is None else tool.compress(x.encode("utf-8", "replace")) for x in columns[at].to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(run, schema)


def unsqueezed(frames: pa.Array) -> list[str | None]:
    """The texts of a column that squeezed() made."""
    tool = zstandard.ZstdDecompressor()
    return [None if x is None else tool.decompress(x).decode("utf-8", "replace") for x in frames.to_pylist()]


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """The texts of at most ``most`` labelled documents, chosen by a hash of their id (a documented bound)."""
    chosen = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", "quality", F.coalesce("toxic", F.lit(0)).alias("toxic"))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


#: Bits of a key bitmap: 4 MB whatever the input; with more keys than bits it only marks more rows.
KEY_BITS = 1 << 25


def bitmap_of(rows: DataFrame, bit: Column, n_bits: int = KEY_BITS) -> bytes:
    """The bits (non-negative longs, taken modulo n_bits) of all rows as one bitmap, folded on the executors."""
    at = F.pmod(bit, F.lit(n_bits)) + 1
    folded = rows.select(at.alias("b")).groupBy(F.expr("bitmap_bucket_number(b)").alias("part")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(b))").alias("map"))
    bits = np.zeros(n_bits // 8 + 4096, np.uint8)
    for part, found in folded.collect():  # n_bits / 32768 rows of 4 KB at most
        bits[(part - 1) * 4096 : part * 4096] = np.frombuffer(found, np.uint8)
    return bits[: n_bits // 8].tobytes()


def marked(bits: bytes, bit: np.ndarray) -> np.ndarray:
    """Which of these bits (taken modulo the bitmap's size) are set."""
    at = bit & (len(bits) * 8 - 1)
    return (np.frombuffer(bits, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def marked_by(keys: DataFrame, key: str, n_bits: int = KEY_BITS):
    """A column function telling whether a long key may be among ``keys``: never wrongly false.

    The keys are folded into a bitmap of fixed size on the executors, so rows that surely have no partner need
    not move in the join that follows.
    """
    shared = keys.sparkSession.sparkContext.broadcast(bitmap_of(keys, F.col(key), n_bits))

    @F.pandas_udf("boolean")
    def may_have(k: pd.Series) -> pd.Series:
        return pd.Series(marked(shared.value, k.to_numpy(np.int64)))

    return may_have


def fresh(columns: list[str], *names: str) -> list[str]:
    """Each name with as many underscores before it as keep it from clashing with columns."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out
