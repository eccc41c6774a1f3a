"""Media columns with content-defined chunking: store payloads once per chunk, read them back verified.

A payload is stored as an 8-bit mono WAV. A rolling gear hash over the last 32 bytes sets the chunk borders, so
equal passages give equal chunks. Chunk digests are counted in Spark; a bitmap of fixed size marks those that
several media may share. A medium's row keeps its ordered chunk list; the bytes of a chunk stay in that row
unless the bitmap marks its digest, in which case they go to the chunk store, deduplicated by digest. Reading
joins the lists to the store by digest, puts the chunks together in order and checks the medium's SHA-256.
Only shared chunks ever move; a bitmap bit set by chance costs movement, never correctness.

Defined cases: a null or empty text is 64 zero bytes; repeated rows are media of their own that share all
chunks; null doc_ids are kept; an empty table gives an empty result; other input columns are ignored. A missing
or altered chunk raises an error on reading.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specweave.llm.common import documents, stage, whole_text

UNIT = 64
#: Chunk sizes in bytes: least, mean beyond the least (a power of two), most.
LEAST, MEAN, MOST = 256, 2048, 16_384
#: Bits of the bitmap of shared digests: 4 MB, whatever the input.
BITS = 1 << 25
SAMPLE_RATE = 8000
#: Digests a task remembers so as not to send a chunk twice.
REMEMBERED = 1_000_000
_GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)


def payload_of(text: str) -> bytes:
    raw = text.encode("utf-8", "replace")
    return raw + bytes(-len(raw) % UNIT if raw else UNIT)


def to_media(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(SAMPLE_RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_media(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def chunks(data: bytes) -> list[bytes]:
    """Cut where the gear hash of the last 32 bytes has its upper bits 0; the first LEAST bytes of a chunk have no cut."""
    if len(data) <= LEAST:
        return [data]
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for s in (1, 2, 4, 8, 16):
        h[s:] += h[:-s] << np.uint32(s)
    cuts = np.flatnonzero(h < np.uint32((1 << 32) // MEAN)) + 1
    out, start = [], 0
    while start < len(data):
        i = np.searchsorted(cuts, start + LEAST)
        end = min(int(cuts[i]) if i < len(cuts) else len(data), start + MOST, len(data))
        out.append(data[start:end])
        start = end
    return out


def _digest(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()


def _bit(digest: bytes) -> int:
    return int.from_bytes(digest[:4], "big") % BITS


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_digest(c) for text in batch.column(0).to_pylist() for c in chunks(to_media(payload_of(text)))]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(map(_bit, found), pa.int64())], ["digest", "bit"])


def store_media(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(media, chunk store): media(row, doc_id, n_bytes, media_sha256, chunks), store(digest, bytes)."""
    texts = docs.select("doc_id", whole_text().alias("text"))
    counted = texts.select("text").mapInArrow(_lists, "digest binary, bit long").groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.first("bit").alias("bit")).where("n > 1")
    maps = counted.groupBy(F.expr("bitmap_bucket_number(bit + 1)").alias("part")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit + 1))").alias("map"))
    bits = np.zeros(BITS // 8 + 4096, np.uint8)
    for part, found in maps.collect():  # BITS / 32768 rows of 4 KB at most
        bits[(part - 1) * 4096 : part * 4096] = np.frombuffer(found, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits.tobytes())
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, row long, n_bytes long, media_sha256 string, chunks array<struct<digest: binary, bytes: binary>>, digest binary, bytes binary"
    arrow = pa.list_(pa.struct([("digest", pa.binary()), ("bytes", pa.binary())]))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, sent, row = shared.value, set(), TaskContext.get().partitionId() << 40
        for batch in batches:
            at, rows, sizes, sums, lists, keys, stored = [], [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                media = to_media(payload_of(text))
                own = []
                for c in chunks(media):
                    d = _digest(c)
                    b = _bit(d)
                    if marks[b >> 3] >> (b & 7) & 1:
                        own.append({"digest": d, "bytes": None})
                        if d not in sent:
                            if len(sent) >= REMEMBERED:
                                sent.clear()
                            sent.add(d)
                            keys.append(d)
                            stored.append(c)
                    else:
                        own.append({"digest": d, "bytes": c})
                at.append(i)
                rows.append(row)
                sizes.append(len(text.encode("utf-8", "replace")))
                sums.append(hashlib.sha256(media).hexdigest())
                lists.append(own)
                row += 1
            n, m = len(at), len(keys)
            none = [None] * m
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at + none, pa.int64())), pa.array(rows + none, pa.int64()), pa.array(sizes + none, pa.int64()), pa.array(sums + none, pa.string()), pa.array(lists + none, arrow),
                    pa.array([None] * n + keys, pa.binary()), pa.array([None] * n + stored, pa.binary()),
                ],
                ["doc_id", "row", "n_bytes", "media_sha256", "chunks", "digest", "bytes"],
            )

    table = stage(texts.mapInArrow(write, schema), "media")
    store = stage(table.where("row IS NULL").select("digest", "bytes").dropDuplicates(["digest"]), "media-chunks")
    return table.where("row IS NOT NULL").select("row", "doc_id", "n_bytes", "media_sha256", "chunks"), store


def feature_of(payload: bytes) -> str:
    """Mean, deviation and crossings of the middle of the samples."""
    x = np.frombuffer(payload, np.uint8).astype(np.float64) - 128
    return f"mean={x.mean():.4f};std={x.std():.4f};crossings={int(np.count_nonzero(np.diff(x >= 0)))}"


def read_media(media: DataFrame, store: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, n_chunks of each verified medium."""
    lacking = F.exists("chunks", lambda c: c["bytes"].isNull())
    whole = media.where(~lacking).select("doc_id", "n_bytes", "media_sha256", F.col("chunks.bytes").alias("parts"))
    refs = media.where(lacking).select("row", "doc_id", "n_bytes", "media_sha256", F.posexplode("chunks").alias("seq", "c"))
    own = refs.where("c.bytes IS NOT NULL").select("row", "doc_id", "n_bytes", "media_sha256", "seq", F.col("c.bytes").alias("bytes"))
    found = refs.where("c.bytes IS NULL").select("row", "doc_id", "n_bytes", "media_sha256", "seq", F.col("c.digest").alias("digest")).join(store, "digest", "left").drop("digest")
    put = own.unionByName(found).groupBy("row", "doc_id", "n_bytes", "media_sha256").agg(F.sort_array(F.collect_list(F.struct("seq", "bytes"))).alias("p"))
    parts = whole.unionByName(put.select("doc_id", "n_bytes", "media_sha256", F.col("p.bytes").alias("parts")))
    kind = media.schema["doc_id"].dataType.simpleString()
    columns = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for expected, pieces in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                stored = b"".join(pieces)
                if hashlib.sha256(stored).hexdigest() != expected:
                    raise ValueError("a medium differs from what was stored")
                payload = from_media(stored)
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(stored), expected, feature_of(payload), len(pieces)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            values = [pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *values], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_chunks"])

    return parts.mapInArrow(read, f"doc_id {kind}, {columns}")


def op6_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_media(*store_media(documents(spark, sf_dir)))
