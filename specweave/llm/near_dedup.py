"""Near-duplicate classes by order MinHash over word shingles, verified by banded alignment.

Shingles of five words are labelled with their occurrence number. Each of SKETCHES hash functions samples the
two least labelled shingles and keeps them in text order, so an entry agrees only if the shingles and their
order agree; it follows edit similarity. Entries are banded by three. Texts with equal words are collapsed
first. In each bucket members are held against the member that meets most others. Where that leaves several
classes in a bucket, its members meet members of other classes in an exact join on their rarest shingles, with
prefix, length and positional filters; so no link between different texts of a bucket is lost, and groups are
not expanded into pairs. A candidate is verified by an alignment of
its two shingle sequences within a band that no pair of the wanted similarity leaves; its similarity is
aligned / (n + m - aligned), at least 0.8. Classes are the connected components of the verified links.

A pair of similarity 0.8 shares a bucket with probability 0.999; above it with more.

Defined cases: null and empty texts have no shingle and form one class of equal texts; a text of fewer than five
words has all its words as its one shingle; repeated rows are equal texts; the class id is the least doc_id of
the class, null only if all its ids are null; exactly one row of each class has keep = true; ties go to the
first row; other input columns are kept, those named as an output column are replaced.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from specweave.llm import wordhash
from specweave.llm.common import documents, stage, trimmed
from specweave.llm.graph import components
from specweave.llm.line_dedup import COUNTS, GROUPS, TABLE, levels_of, sliced, wide_parities

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 3
SKETCHES = BANDS * ROWS
#: Hash values held at a time while sketching one text.
HELD = 4_000_000
#: Prefix entries of texts put out at a time, and those of one text more.
HELD_ENTRIES = 1 << 15
_RNG = np.random.default_rng(977)
_ODD = (_RNG.integers(0, 1 << 63, SKETCHES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_POWERS = (_RNG.integers(0, 1 << 63, SHINGLE + 3, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def labelled_shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of a text's shingles, from those of its words, each with its occurrence number."""
    k = min(SHINGLE, len(words))
    n = len(words) - k + 1
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h += words[i : i + n] * _POWERS[i]
    h = _mix(h)
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.concatenate([[True], s[1:] != s[:-1]])
    occurrence = np.empty(n, np.uint64)
    at = np.arange(n)
    occurrence[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    return _mix(h + occurrence * _POWERS[-1])


def bands_of(words: np.ndarray) -> list[int]:
    """Bucket keys of a text from its words' hashes; none without words."""
    if not len(words):
        return []
    h = labelled_shingles(words)
    entries = np.full(SKETCHES, h[0])
    if len(h) > 1:
        step = max(1, HELD // len(h))
        for i in range(0, SKETCHES, step):
            values = h[None, :] * _ODD[i : i + step, None]
            least = values.argmin(1)
            values[np.arange(len(values)), least] = np.uint64((1 << 64) - 1)
            next_ = values.argmin(1)
            # In text order, so an entry agrees only if both shingles and their order do.
            entries[i : i + step] = h[np.minimum(least, next_)] * _POWERS[0] + h[np.maximum(least, next_)] * _POWERS[1]
    b = entries.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _POWERS[-2]
    for i in range(ROWS):
        key = _mix(key + b[:, i] * _POWERS[i])
    return key.view(np.int64).tolist()


def aligned(a: list[int], b: list[int], band: int) -> int:
    """Longest common subsequence of a and b with |i - j| <= band, by bits of one long integer per row."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    row, full = (1 << len(b)) - 1, (1 << len(b)) - 1
    window = (1 << 2 * band + 1) - 1
    for i, x in enumerate(a):
        if found := places.get(x):
            inside = window << i - band if i >= band else window >> band - i
            if found := row & found & inside:
                row = ((row + found) | (row - found)) & full
    return len(b) - row.bit_count()


def similarity(a: list[bytes], b: list[bytes]) -> float:
    """Aligned shingles over all shingles; exact from SIMILARITY upwards, else possibly too small."""
    number: dict[tuple, int] = {}

    def numbered(w):
        k = min(SHINGLE, len(w))
        return [number.setdefault(s, len(number)) for s in zip(*(w[i:] for i in range(k)), strict=False)] if k else []

    x, y = numbered(a), numbered(b)
    if not x or not y:
        return float(x == y)
    most = sum((Counter(x) & Counter(y)).values())
    if most < SIMILARITY * (len(x) + len(y) - most):
        return most / (len(x) + len(y) - most) if most else 0.0
    n, m, start = len(x), len(y), 0
    while start < min(n, m) and x[start] == y[start]:
        start += 1
    end = 0
    while end < min(n, m) - start and x[-1 - end] == y[-1 - end]:
        end += 1
    # At similarity 0.8 each side has at most a quarter of the shorter text unaligned.
    got = start + end + aligned(x[start : n - end], y[start : m - end], int(0.25 * min(n, m)) + 1)
    return got / (n + m - got)


def _sketch(schema, at: int):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        names = to_arrow_schema(schema).names
        for batch in batches:
            digests, sizes, keys = [], [], []
            for _, texts in wordhash.parts(batch.column(at)):
                for w in wordhash.words(texts):
                    digests.append(hashlib.blake2b(w.tobytes(), digest_size=16).digest())
                    sizes.append(len(w) - min(SHINGLE, len(w)) + 1 if len(w) else 0)
                    keys.append(bands_of(w))
            rows = pa.array(range(row, row + len(digests)), pa.int64())
            row += len(digests)
            added = [rows, pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=names)

    return run


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are similar."""
    left = pairs.join(texts.select(F.col("_row").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("_row").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = pa.array([similarity(words_of(x or ""), words_of(y or "")) >= SIMILARITY for x, y in zip(a, b, strict=True)], pa.bool_())
            yield batch.select([0, 1]).filter(keep)

    return both.mapInArrow(run, "a long, b long")


@trimmed
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often a task's shingles occur, by bucket of the rarity table."""
    table, task = np.zeros(TABLE, np.uint32), TaskContext.get().partitionId() % GROUPS
    for batch in batches:
        h = batch.column(0).flatten().to_numpy().view(np.uint64)
        at, n = np.unique((h & np.uint64(TABLE - 1)).astype(np.uint32), return_counts=True)
        table[at] += n.astype(np.uint32)
    yield sliced(table, task)


def prefix(h: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingles of a text in which a similar text must share one, shingles from each on).

    Order is by level, then by hash. A shingle that is alone in its bucket takes its place, but no other text has it.
    """
    level = levels[(h & np.uint64(TABLE - 1)).astype(np.int64)]
    order = np.lexsort((h, level))[: len(h) - int(np.ceil(len(h) * SIMILARITY - 1e-9)) + 1]
    kept = np.flatnonzero(level[order] > 1)
    return h[order[kept]], len(h) - kept


def _between_classes(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Pairs (a, b) of different label that may be similar: all that the prefix and positional filters leave.

    Shingles are ordered by rarity among the rows, in a table of fixed size (collisions cost speed, not results), so
    that each text finds its own prefix and only prefixes move. Shingles that one row alone has come first and cannot
    match, so a text with many edits of its own meets nobody, however large its family is. A shingle that one class
    alone has is left out, too; of another's largest class members meet the other classes, not each other. 512 bits
    of parity of the shingles bound the difference of two texts from below, so of a family whose members are too far
    apart few pairs remain.
    """
    parity = [f"p{i}" for i in range(8)]

    @trimmed
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [labelled_shingles(w) for _, texts in wordhash.parts(batch.column(3)) for w in wordhash.words(texts)]
            flat = np.concatenate([np.zeros(0, np.uint64), *found])
            wide = wide_parities(flat, np.array([len(x) for x in found], np.int64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64())), *(pa.array(np.ascontiguousarray(wide[:, i])) for i in range(8))], ["row", "size", "label", "shingles", *parity])

    texts = rows.join(sources.withColumnRenamed("_row", "row"), "row").select("row", "size", "label", "text")
    listed = stage(texts.mapInArrow(sets, "row long, size int, label long, shingles array<long>, " + ", ".join(f"{p} long" for p in parity)), "near-sets")
    table = rows.sparkSession.sparkContext.broadcast(levels_of(listed.select("shingles").mapInArrow(_count, COUNTS))[0])

    @trimmed
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = np.frombuffer(table.value, np.uint8)
        for batch in batches:
            lists, lo = batch.column(0), 0
            while lo < len(lists):
                found, held = [], 0
                while lo + len(found) < len(lists) and held < HELD_ENTRIES:
                    found.append(prefix(lists[lo + len(found)].values.to_numpy().view(np.uint64), levels))
                    held += len(found[-1][0])
                of = pa.array(np.repeat(np.arange(lo, lo + len(found)), [len(x) for x, _ in found]))
                shingles, rest = (np.concatenate([np.zeros(0, kind), *x]) for kind, x in zip((np.uint64, np.int64), zip(*found, strict=True), strict=True))
                yield pa.RecordBatch.from_arrays([*(x.take(of) for x in batch.columns[1:]), pa.array(shingles.view(np.int64)), pa.array(rest)], ["row", "size", "label", *parity, "shingle", "rest"])
                lo += len(found)

    schema = "row long, size int, label long, " + ", ".join(f"{p} long" for p in parity) + ", shingle long, rest long"
    every = stage(listed.select("shingles", "row", "size", "label", *parity).mapInArrow(prefixes, schema), "near-prefixes")
    held = every.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("n"))
    several = held.groupBy("shingle").agg(F.max(F.struct("n", "label")).alias("most"), F.count(F.lit(1)).alias("classes")).where("classes > 1").select("shingle", F.col("most.label").alias("main"))
    entries = stage(every.join(several, "shingle").withColumn("main", F.col("label") == F.col("main")), "near-entries")
    other = entries.where("NOT main").drop("main").toDF("shingle", "b", "size_b", "label_b", *(f"{p}_b" for p in parity), "rest_b")
    need = F.ceil((F.col("size") + F.col("size_b")) * (SIMILARITY / (1 + SIMILARITY)) - 1e-9)
    apart = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(f"{p}_b"))) for p in parity), F.lit(0))
    met = entries.join(other, "shingle").where((F.col("main") | (F.col("row") < F.col("b"))) & (F.col("label") != F.col("label_b")) & (F.least("rest", "rest_b") >= need) & (apart <= F.col("size") + F.col("size_b") - 2 * need))
    return stage(met.select(F.least("row", "b").alias("a"), F.greatest("row", "b").alias("b")).distinct(), "near-pairs")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with class_id, n_checked_links and keep.

    n_checked_links counts the verified pairs of a text with heads of its buckets, and those found late between
    classes; not all similar texts, as members of a family need not be held against each other.
    """
    kept = [c for c in docs.columns if c not in ("class_id", "n_checked_links", "keep")]
    # Inside, other columns have names of their own, so none clashes.
    own_names = {c: "text" if c == "text" else "doc_id" if c == "doc_id" else f"_own{i}" for i, c in enumerate(kept)}
    docs = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in own_names.items()))
    schema = T.StructType(docs.schema.fields + T.StructType.fromDDL("_row long, _digest binary, _size int, _bands array<long>").fields)
    all_rows = stage(docs.mapInArrow(_sketch(schema, kept.index("text")), schema), "near-rows")

    # One row for each distinct text; its least (doc_id, row) stands for it.
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("_row").alias("row"))
    texts = stage(
        all_rows.groupBy("_digest").agg(F.min(first).alias("first"), F.first("_size").alias("size"), F.first("_bands").alias("bands")).select("_digest", "first.doc_id", "first.row", "size", "bands"),
        "near-texts",
    )
    members = texts.where("size > 0").select("row", "size", F.explode("bands").alias("key"))
    buckets = stage(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "near-buckets")
    shared = stage(members.join(buckets, "key").select("key", "row", "size", "n"), "near-shared")
    # The head of a bucket is the member that meets most others over all its buckets: the middle of its family.
    met = shared.groupBy("row").agg(F.sum("n").alias("met"))
    best = F.max_by(F.struct("row", "size"), F.struct("met", (-F.col("row")).alias("r")))
    heads = stage(shared.join(met, "row").groupBy("key").agg(best.alias("h")).select("key", F.col("h.row").alias("head"), F.col("h.size").alias("head_size")), "near-heads")
    fits = lambda x, y: F.col(x) * SIMILARITY <= F.col(y)  # noqa: E731  lengths differ too much otherwise
    headed = stage(shared.select("key", "row", "size").join(heads, "key"), "near-headed")
    pairs = headed.where((F.col("row") != F.col("head")) & fits("size", "head_size") & fits("head_size", "size")).select("row", "head").distinct()
    sources = all_rows.select("_row", "text")
    links = stage(_verified(pairs.select(F.col("row").alias("a"), F.col("head").alias("b")), sources), "near-links")

    # Members of buckets that still hold several classes meet by an exact prefix-filtered join.
    classes = components(links)
    placed = stage(headed.join(classes.withColumnRenamed("node", "row"), "row", "left").select("key", "row", "size", F.coalesce("label", "row").alias("label")), "near-placed")
    open_keys = placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi AND n > 2").select("key")
    open_rows = stage(placed.join(open_keys, "key", "left_semi").select("row", "size", "label").distinct(), "near-open")
    if not open_rows.isEmpty():
        late = stage(_verified(_between_classes(open_rows, sources), sources), "near-late")
        if not late.isEmpty():
            links = stage(links.unionByName(late), "near-links")
            classes = components(links)

    ends = links.select(F.explode(F.array("a", "b")).alias("row")).groupBy("row").agg(F.count(F.lit(1)).alias("n_checked_links"))
    own = texts.select("_digest", "row").join(classes.withColumnRenamed("node", "row"), "row", "left").join(ends, "row", "left")
    own = stage(own.select("_digest", F.coalesce("label", "row").alias("label"), F.coalesce("n_checked_links", F.lit(0)).cast("long").alias("n_checked_links")), "near-own")
    # The least doc_id of a class names it and stays.
    stays = texts.join(own, "_digest").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row"))).alias("first"))
    stays = stage(stays.select("label", F.col("first.doc_id").alias("class_id"), F.col("first.row").alias("stays")), "near-stays")
    named = stage(own.join(stays, "label").select("_digest", "class_id", "n_checked_links", "stays"), "near-named")
    done = all_rows.select(*docs.columns, "_row", "_digest").join(named, "_digest")
    return done.select(*(F.col(n).alias(c) for c, n in own_names.items()), "class_id", "n_checked_links", (F.col("_row") == F.col("stays")).alias("keep"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
