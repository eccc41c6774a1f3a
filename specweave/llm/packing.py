"""Packing of documents into sequences of bounded length: first-fit decreasing in randomised groups.

A document's ids (and an end id) are cut into full sequences and a rest. Pieces are dealt at random into
groups of bounded expected size, so no task sees more than a group; each group is packed on its own by
first-fit decreasing, where a tournament tree over the free room of the bins finds the first bin that has
enough in logarithmic time.

Defined cases: a null or empty text is the end id alone; repeated rows and null doc_ids give their own
pieces; ties in length are broken by row and start; an empty table gives an empty result; columns of the
input other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specweave.llm.common import documents, stage, whole_text
from specweave.llm.subwords import subwords, tokenizer_path

LENGTH = 2048
END_ID = 1
#: Pieces in a group, on average.
GROUP = 4096


def first_fit_decreasing(lengths: list[int], room: int) -> tuple[list[int], list[int]]:
    """The bin and the offset of each item; items of equal length keep their order."""
    n = len(lengths)
    leaves = 1 << max(0, (n - 1).bit_length())
    tree = [room] * (2 * leaves)  # the most free room below each node
    bins, offsets = [0] * n, [0] * n
    for i in sorted(range(n), key=lambda i: -lengths[i]):
        need, node = lengths[i], 1
        while node < leaves:
            node *= 2
            if tree[node] < need:
                node += 1
        bins[i], offsets[i] = node - leaves, room - tree[node]
        tree[node] -= need
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
    return bins, offsets


def _pieces(path: str, length: int, end_id: int):
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, row = subwords(path), TaskContext.get().partitionId() << 40
        for batch in batches:
            at, out = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = coder.encode(text) + end
                n = len(ids) // 4
                for start in range(0, n, length):
                    piece = ids[4 * start : 4 * (start + length)]
                    at.append(i)
                    out.append((row, start, len(piece) // 4, zlib.crc32(piece), n))
                row += 1
            columns = np.array(out, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *map(pa.array, columns)], ["doc_id", "row", "start", "length", "ids_crc32", "doc_tokens"])

    return cut


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID, group: int = GROUP) -> DataFrame:
    """One row per piece: doc_id, row, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    numbers = "row long, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = docs.select("doc_id", whole_text().alias("text")).mapInArrow(_pieces(path or tokenizer_path(), length, end_id), f"doc_id {kind}, {numbers}")
    pieces = stage(pieces, "pack-pieces")
    groups = max(1, math.ceil(pieces.count() / group))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "start"], ignore_index=True)
        bins, offsets = first_fit_decreasing(pdf["length"].tolist(), length)
        return pdf.assign(sequence_id=(pdf.pop("part").to_numpy(np.int64) << 32) + np.array(bins, np.int64), offset=np.array(offsets, np.int64))

    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("row", "start"), F.lit(groups)))
    return dealt.groupBy("part").applyInPandas(fill, f"doc_id {kind}, {numbers}, sequence_id long, offset long")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir)).drop("row")
