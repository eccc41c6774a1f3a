"""Line dedup by an exact set-similarity join: a line goes if an earlier line has Jaccard similarity >= 0.8.

A line is the set of its lower-cased words. The words of each set are ordered by rarity (counts of all texts in a
table of fixed size; collisions cost speed, not results), and only the prefix in which two similar sets must share
a word is indexed; words that occur once are left out. Index entries are dealt by word to parts of bounded size,
packed, so few rows move. In a part the entries of a word meet under the length and positional filters and a bound
on the difference that 128 bits of parity give; of what passes, only the best partner of a line is reported, and
Jaccard is verified on the whole lines. Lines whose best partner fails although there are others meet these again,
in a second round over the words and sizes concerned with 512 bits more, and what that leaves open in a third one
with all words of the sets. So each line is held against every earlier line it could match,
but groups of similar lines are not expanded into pairs. The entries of a frequent word are dealt in blocks; its
lines visit all blocks.

Equal sets are found by 128-bit digests, which are parts of the same index.

The order of lines is doc_id (null last; ids that are no integers by their hash), a hash of the document, line
number. Whether a line goes depends on all earlier lines, kept or not, so the result depends neither on
partitioning nor on the order of work.

Defined cases: a null or empty text has no line to remove; lines without a word stay; equal rows (same doc_id
and text) are one document and treated alike; an empty table gives an empty result; other columns are kept, those
named n_lines or n_removed are replaced, and n_chars, if there, is set to the new length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specweave.llm import wordhash
from specweave.llm.common import bitmap_of, documents, fresh, give_back, marked, marked_by, small_batches, squeezed, stage, trimmed, unsqueezed, whole_text

SIMILARITY = 0.8
#: Sets of fewer words can only equal another set or are matched by one of this size.
LEAST_JOINED = 4
#: Entries of the rarity table (one byte each), in slices of 65,536.
TABLE, SLICE = 1 << 24, 1 << 16
#: What a task tells of its counts.
COUNTS = "part int, task int, counts binary"
#: Groups in which the counts of a slice are added before they meet.
GROUPS = 256
#: Words of the texts for each part of the index, and parts at least.
PART_WORDS, LEAST_PARTS = 8_000_000, 64
#: Entries of one word in a block, on average; a word with more has several blocks. How many is estimated from the
#: entries of one document in SAMPLED, which sets how work is dealt but no result.
BLOCK, SAMPLED = 50_000, 64
#: Late lines that are broadcast at most (some 30 bytes each); with more the documents concerned are shuffled.
MAX_BROADCAST = 1_000_000
#: Pairs looked at at once.
AT_ONCE = 1 << 18
#: An index entry, 48 bytes. at, key and line name a line; rest counts the words from this one on.
ENTRY = np.dtype([("word", "<u4"), ("block", "<u2"), ("role", "<u2"), ("at", "<i8"), ("key", "<u4"), ("line", "<u4"), ("size", "<u4"), ("rest", "<u4"), ("id", "<u4"), ("near", "<u8"), ("more", "<u8")])
#: Roles of an entry: it is met by later lines, it looks for earlier ones.
MET, LOOKS = 1, 2
#: An equal-set entry.
SAME = np.dtype([("digest", "<u8"), ("other", "<u8"), ("at", "<i8"), ("key", "<u4"), ("line", "<u4")])


def packed(rows: np.ndarray) -> bytes:
    """Rows byte plane by byte plane, so that the many equal bytes of small numbers compress."""
    return np.ascontiguousarray(rows.view(np.uint8).reshape(len(rows), rows.dtype.itemsize).T).tobytes()


def unpacked(data: bytes, kind: np.dtype) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _level(counts: np.ndarray) -> np.ndarray:
    """Counts up to 128 as they are, larger ones by logarithm, in 8 bits."""
    c = np.maximum(counts, 1)
    return np.where(c <= 128, c, np.minimum(255, 128 + np.maximum(1, 4 * np.log2(c / 128)))).astype(np.uint8)


def _is_frequent(level: np.ndarray) -> np.ndarray:
    """Whether words of this level may have more than BLOCK entries."""
    return 128 * 2 ** ((level.astype(np.float64) - 127) / 4) > BLOCK


@trimmed
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The word counts of a task by slice: places and counts of four bytes each."""
    table, task = np.zeros(TABLE, np.uint32), TaskContext.get().partitionId() % GROUPS
    for batch in batches:
        for _, texts in wordhash.parts(batch.column(0)):
            at, n = np.unique((wordhash.words(texts).h & np.uint64(TABLE - 1)).astype(np.uint32), return_counts=True)
            table[at] += n.astype(np.uint32)
    yield sliced(table, task)


def sliced(table: np.ndarray, task: int) -> pa.RecordBatch:
    at = np.flatnonzero(table)
    of = at // SLICE
    ends = np.flatnonzero(np.diff(of, append=-1)) + 1
    pairs = np.stack([(at % SLICE).astype(np.uint32), table[at].astype(np.uint32)])
    blobs = [np.ascontiguousarray(pairs[:, a:b]).tobytes() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)] if len(at) else []
    part = of[ends - 1] if len(at) else of
    return pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(np.full(len(part), task, np.int32)), pa.array(blobs, pa.binary())], ["part", "task", "counts"])


def _added(listed: list[bytes]) -> np.ndarray:
    row = np.zeros(SLICE, np.int64)
    for blob in listed:
        at, n = np.frombuffer(blob, "<u4").reshape(2, -1)
        row[at] += n
    return row


@trimmed
def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [np.minimum(_added(x), (1 << 32) - 1) for x in batch.column(1).to_pylist()]
        blobs = [np.stack([at.astype(np.uint32), r[at].astype(np.uint32)]).tobytes() for r in rows for at in [np.flatnonzero(r)]]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], ["part", "counts"])


@trimmed
def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = [_added(x) for x in batch.column(1).to_pylist()]
        rows = [np.where(x > 0, _level(x), 0).astype(np.uint8).tobytes() for x in sums]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary()), pa.array([int(x.sum()) for x in sums], pa.int64())], ["part", "levels", "n"])


def rarity(texts: DataFrame) -> tuple[bytes, int]:
    """(how often each word occurs, by bucket of the table; number of words) over all texts."""
    return levels_of(texts.select("text").mapInArrow(_count, COUNTS))


def levels_of(counts: DataFrame) -> tuple[bytes, int]:
    """(table of levels, sum) of the counts of all tasks, each of them sliced as by sliced."""
    merged = counts.groupBy("part", "task").agg(F.collect_list("counts").alias("counts")).select("part", "counts").mapInArrow(_merge, "part int, counts binary")
    sums = merged.groupBy("part").agg(F.collect_list("counts").alias("counts")).mapInArrow(_levels, "part int, levels binary, n long")
    table, total = np.zeros(TABLE, np.uint8), 0
    with small_batches(counts.sparkSession):
        rows = sums.collect()  # 256 rows of 64 KB
    for part, levels, n in rows:
        table[part * SLICE : (part + 1) * SLICE] = np.frombuffer(levels, np.uint8)
        total += n
    del rows
    give_back()
    return table.tobytes(), total


def order_of(docs: DataFrame) -> Column:
    """A long that orders documents by doc_id: integers as they are, other ids by their hash, null last."""
    own = F.col("doc_id").cast("long") if isinstance(docs.schema["doc_id"].dataType, T.IntegralType) else F.xxhash64(F.col("doc_id").cast("string"))
    return F.coalesce(own, F.lit((1 << 63) - 1))


def _keyed(docs: DataFrame) -> dict[str, Column]:
    """The columns _at and _key that name a document."""
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), whole_text()).bitwiseAND(F.lit((1 << 32) - 1))
    return {"_at": order_of(docs), "_key": key}


def line_sets(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """The word sets of all lines that have words.

    (text, line, size, first word of each set) and, for all words of all sets in order, the hashes.
    """
    data, offsets = wordhash.raw(texts)
    starts, ends = wordhash.borders(data, offsets)
    h = wordhash.hashes(data, starts, ends)
    first = np.searchsorted(starts, offsets)
    text, line = wordhash.lines(data, offsets, starts, first)
    if not len(h):
        none = np.zeros(0, np.int64)
        return none, none, none, none, h
    own = np.cumsum(np.concatenate([[0], (np.diff(text) != 0) | (np.diff(line) != 0)]))
    order = np.argsort(own.astype(np.uint64) << np.uint64(40) | h >> np.uint64(24))
    own, h, text, line = own[order], h[order], text[order], line[order]
    new = np.concatenate([[True], (own[1:] != own[:-1]) | (h[1:] != h[:-1])])
    own, h, text, line = own[new], h[new], text[new], line[new]
    at = np.flatnonzero(np.diff(own, prepend=-1))
    return text[at], line[at], np.diff(np.append(at, len(h))), at, h


def digests(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent sums over the words of each set."""
    add = lambda x: np.add.reduceat(x, at)
    return add(wordhash.mix(h + np.uint64(0x51ED270B0A1F39C1))), add(wordhash.mix(h ^ np.uint64(0xA3B195354A39B70D)))


def parities(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of parity of each set: two sets differ in at least as many words as in bits."""
    bit, low = np.uint64(1) << (h & np.uint64(63)), (h & np.uint64(64)) == 0
    return np.bitwise_xor.reduceat(np.where(low, bit, np.uint64(0)), at), np.bitwise_xor.reduceat(np.where(low, np.uint64(0), bit), at)


def wide_parities(words: np.ndarray, size: np.ndarray) -> np.ndarray:
    """512 bits of parity of each set, as rows of eight; words: those of all sets in order."""
    out = np.zeros((len(size), 8), np.uint64)
    of = np.repeat(np.arange(len(size)), size)
    np.bitwise_xor.at(out, (of, (words >> np.uint64(12) & np.uint64(7)).astype(np.int64)), np.uint64(1) << (words >> np.uint64(15) & np.uint64(63)))
    return out


def spread(values: np.ndarray, at: np.ndarray, size: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The values of the chosen sets in order."""
    n = size[chosen]
    return values[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at[chosen], n)]


def needed(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Words that sets of n and m words must share."""
    return np.ceil((n + m) * (SIMILARITY / (1 + SIMILARITY)) - 1e-9).astype(np.int64)


def prefixes(size: np.ndarray, h: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(set, word, words from it on, level) of the indexed words of the sets."""
    of = np.repeat(np.arange(len(size), dtype=np.uint64), size)
    key = of << np.uint64(40) | levels[(h & np.uint64(TABLE - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(32) | h >> np.uint64(32)
    key.sort()
    starts = np.cumsum(size) - size
    length = np.where(size >= LEAST_JOINED, size - np.ceil(SIMILARITY * size - 1e-9).astype(np.int64) + 1, 0)
    place = np.arange(len(h)) - np.repeat(starts, size)
    kept = np.flatnonzero((place < np.repeat(length, size)) & (key >> np.uint64(32) & np.uint64(255) > 1))
    key, place = key[kept], place[kept]
    of = (key >> np.uint64(40)).astype(np.int64)
    return of, key.astype(np.uint32), size[of] - place, (key >> np.uint64(32) & np.uint64(255)).astype(np.uint8)


def _dealt(rows: np.ndarray, part: np.ndarray) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """(part, packed rows, their places) of each part."""
    order = np.argsort(part, kind="stable")
    rows, part = rows[order], part[order]
    ends = np.flatnonzero(np.diff(part, append=-1)) + 1
    lo = 0
    for hi in ends.tolist():
        yield int(part[lo]), packed(rows[lo:hi]), order[lo:hi]
        lo = hi


def entries(size: np.ndarray, h: np.ndarray, at: np.ndarray, name: tuple, ident: np.ndarray, levels: np.ndarray, blocks: np.ndarray, words=None, asked=None) -> tuple[np.ndarray, np.ndarray]:
    """The index entries of sets, and the set of each.

    blocks: (words in order, blocks) of the words with several; words: a bitmap of the words with sizes that count;
    asked: which sets look for partners (default: all).
    """
    of, word, rest, _ = prefixes(size, h, levels)
    if words is not None:
        here = marked(words, _sized(word.astype(np.int64), size[of]))
        of, word, rest = of[here], word[here], rest[here]
    near, more = parities(h, at)
    rows = np.zeros(len(of), ENTRY)
    rows["word"], rows["rest"], rows["size"] = word, rest, size[of]
    rows["at"], rows["key"], rows["line"] = (x[of] for x in name)
    rows["id"], rows["near"], rows["more"] = ident[of].astype(np.uint32), near[of], more[of]
    looks = np.ones(len(of), bool) if asked is None else asked[of]
    rows["role"] = np.where(looks, MET | LOOKS, MET)
    if blocks.shape[1]:
        k = np.minimum(np.searchsorted(blocks[0], word), blocks.shape[1] - 1)
        n = np.where(blocks[0][k] == word, blocks[1][k], 1).astype(np.int64)
        many = np.flatnonzero(n > 1)
        rows["block"][many] = (ident[of[many]] >> np.uint64(32)) % n[many].astype(np.uint64)
        many = many[looks[many]]
        n, again = n[many], np.repeat(many, n[many])
        visits = rows[again]
        visits["block"] = np.arange(len(again)) - np.repeat(np.cumsum(n) - n, n)
        away = visits["block"] != rows["block"][again]
        visits["role"] = LOOKS
        rows, of = np.concatenate([rows, visits[away]]), np.concatenate([of, of[again[away]]])
    return rows, of


def frequent(texts: DataFrame, levels: bytes) -> np.ndarray:
    """(words in order, blocks) of the words with more than BLOCK entries: at most one for each BLOCK entries."""
    if not _is_frequent(np.frombuffer(levels, np.uint8).max(keepdims=True))[0]:
        return np.zeros((2, 0), np.uint32)
    shared = texts.sparkSession.sparkContext.broadcast(levels)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            for _, part in wordhash.parts(batch.column(0)):
                *_, size, _, h = line_sets(part)
                _, word, _, level = prefixes(size, h, table)
                word, n = np.unique(word[_is_frequent(level)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(n)], ["word", "n"])

    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0).select("text").mapInArrow(run, "word long, n long")
    found = sample.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") * SAMPLED > BLOCK).orderBy("word").toArrow()
    n = np.minimum(-(-np.array(found["n"], np.int64) * SAMPLED // BLOCK), 65_535)
    return np.stack([np.array(found["word"], np.int64), n]).astype(np.uint32)


def partners(rows: np.ndarray, every: bool = False, wide: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(rows in order, their places before, later, earlier, number of partners).

    later and earlier are places in the ordered rows: each looking line with its best partner, or with every one.
    wide: more bits of parity of the rows.
    """
    order = np.lexsort((rows["line"], rows["key"], rows["at"]))
    rows = rows[order]
    group = rows["word"].astype(np.uint64) << np.uint64(16) | rows["block"]
    # Of equal sets the first line stays for all: a copy need not look, as its digest tells that it is late.
    same = wordhash.mix(wordhash.mix(group) + wordhash.mix(rows["near"] + (rows["id"].astype(np.uint64) << np.uint64(32) | rows["size"])))
    by = np.argsort(same, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], same[by][1:] != same[by][:-1]])[: len(by)])
    copies = np.diff(np.append(first, len(by)))
    place = np.sort(by[first])
    copies = copies[np.argsort(by[first])]
    place, copies = place[at := np.argsort(group[place], kind="stable")], copies[at]
    rows, order, group = rows[place], order[place], group[place]
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])[: len(group)])
    start = np.repeat(start, np.diff(np.append(start, len(group))))
    n = np.arange(len(rows)) - start  # earlier entries of the same word
    looks = np.flatnonzero((rows["role"] & LOOKS > 0) & (n > 0))
    size, rest, met = rows["size"].astype(np.int64), rows["rest"].astype(np.int64), rows["role"] & MET > 0
    near, more = rows["near"].copy(), rows["more"].copy()
    wide = None if wide is None else wide[order]
    later, earlier, counts = [], [], []
    total, lo = np.cumsum(n[looks]), 0
    while lo < len(looks):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + AT_ONCE, "right")))
        own = looks[lo:hi]
        lo = hi
        j = np.repeat(own, n[own])
        i = np.arange(len(j)) - np.repeat(np.cumsum(n[own]) - n[own], n[own]) + start[j]
        a, b = size[i], size[j]
        fit = np.flatnonzero((a * 5 >= b * 4) & (b * 5 >= a * 4) & met[i])
        i, j, a, b = i[fit], j[fit], a[fit], b[fit]
        need = needed(a, b)
        most = a + b - 2 * need
        far = np.bitwise_count(near[i] ^ near[j]) + np.bitwise_count(more[i] ^ more[j]).astype(np.int64)
        fit = np.flatnonzero((np.minimum(rest[i], rest[j]) >= need) & (far <= most))
        i, j, far, most = i[fit], j[fit], far[fit], most[fit]
        if wide is not None:
            far = np.maximum(far, np.bitwise_count(wide[i] ^ wide[j]).sum(1))
            fit = np.flatnonzero(far <= most)
            i, j, far = i[fit], j[fit], far[fit]
        if not every and len(j):
            best = np.lexsort((i, -copies[i], far, j))
            i, j = i[best], j[best]
            ends = np.flatnonzero(np.diff(j, prepend=-1))
            counts.append(np.diff(np.append(ends, len(j))))
            i, j = i[ends], j[ends]
        later.append(j)
        earlier.append(i)
    flat = lambda x: np.concatenate([np.zeros(0, np.int64), *x])
    return rows, order, flat(later), flat(earlier), flat(counts)


def settled(rows: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """The looking rows that have a similar earlier set; sets: the word hashes of all rows in order."""
    ends = np.cumsum(rows["size"].astype(np.int64))
    rows, order, later, earlier, _ = partners(rows, every=True, wide=wide_parities(sets, rows["size"].astype(np.int64)))
    ends, size = ends[order], rows["size"].astype(np.int64)
    own = lambda i: sets[ends[i] - size[i] : ends[i]]
    found = np.zeros(len(rows), bool)
    for y, x, k in zip(later.tolist(), earlier.tolist(), needed(size[earlier], size[later]).tolist(), strict=True):
        if not found[y]:
            found[y] = len(np.intersect1d(own(y), own(x), assume_unique=True)) >= k
    return rows[found]


def _sized(word, size):
    """A bit for a word in a set of this size; of columns as of arrays."""
    return word * 1_000_003 + size * 40_503


def _code(at: Column, key: Column, line: Column) -> Column:
    low = lambda c: c.bitwiseAND(F.lit((1 << 32) - 1))
    n = low(at) * 40_499 + low(F.shiftrightunsigned(at, 32)) * 40_487 + key * 40_507 + line.cast("long") * 40_503
    return n.bitwiseXOR(F.shiftright(n, 17))


def _codes(at: np.ndarray, key: np.ndarray, line: np.ndarray) -> np.ndarray:
    """As _code."""
    low = np.int64((1 << 32) - 1)
    n = (at & low) * 40_499 + (at >> 32 & low) * 40_487 + key.astype(np.int64) * 40_507 + line.astype(np.int64) * 40_503
    return n ^ n >> 17


def _gather(shared, n_parts: int):
    """(part, packed rows, more of them) of the index: entries by word, then equal sets by digest.

    shared: the levels, the blocks and, in a further round, bitmaps of the lines that look and of the words that
    count, and whether all words go along or wide parities; digests do not then.
    """

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, blocks, asked, wanted, whole = shared.value
        levels = np.frombuffer(table, np.uint8)
        for batch in batches:
            ats, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, texts in wordhash.parts(batch.column(2), size=32 * wordhash.PIECE):
                text, line, size, at, h = line_sets(texts)
                if not len(size):
                    continue
                name = ats[lo + text], keys[lo + text], line
                one, two = digests(h, at)
                looks = None if asked is None else marked(asked, _codes(*name))
                rows, of = entries(size, h, at, name, one, levels, blocks, wanted, looks)
                part = (wordhash.mix(rows["word"].astype(np.uint64) << np.uint64(16) | rows["block"]) % np.uint64(n_parts)).astype(np.int32)
                if asked is None:
                    out = [(p, x, None) for p, x, _ in _dealt(rows, part)]
                    own = np.zeros(len(size), SAME)
                    own["digest"], own["other"], own["at"], own["key"], own["line"] = one, two, *name
                    out += [(n_parts + p, x, None) for p, x, _ in _dealt(own, (one % np.uint64(n_parts)).astype(np.int32))]
                elif whole:
                    out = [(p, x, spread(h, at, size, of[k]).tobytes()) for p, x, k in _dealt(rows, part)]
                else:
                    own, of = np.unique(of, return_inverse=True)
                    wide = wide_parities(spread(h, at, size, own), size[own])
                    out = [(p, x, wide[of[k]].tobytes()) for p, x, k in _dealt(rows, part)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["part", "rows", "more"])

    return run


_MET = "late boolean, at long, key long, line int, xat long, xkey long, xline int, n long, word long, size long"


def _named(late: bool, rows: np.ndarray, x: np.ndarray | None = None, n: np.ndarray | None = None) -> pa.RecordBatch:
    of = lambda r, c, kind: pa.nulls(len(rows), kind) if r is None else pa.array(r[c].astype(np.int64)).cast(kind)
    columns = [pa.array(np.full(len(rows), late)), *(of(r, c, k) for r in (rows, x) for c, k in (("at", pa.int64()), ("key", pa.int64()), ("line", pa.int32())))]
    columns += [pa.nulls(len(rows), pa.int64()) if n is None else pa.array(n), *(of(None if x is None else rows, c, pa.int64()) for c in ("word", "size"))]
    return pa.RecordBatch.from_arrays(columns, ["late", "at", "key", "line", "xat", "xkey", "xline", "n", "word", "size"])


def _meet(n_parts: int, whole: bool):
    """What the rows of each part tell: lines that are late, and lines with the best partner to verify."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part, blobs, more = batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), np.frombuffer(b"".join(batch.column(2)[k].as_py()), np.uint64)
                if part >= n_parts:
                    rows = np.unique(np.concatenate([unpacked(x, SAME) for x in blobs]))  # in order; equal rows are one
                    yield _named(True, rows[1:][(rows["digest"][1:] == rows["digest"][:-1]) & (rows["other"][1:] == rows["other"][:-1])])
                    continue
                rows = np.concatenate([unpacked(x, ENTRY) for x in blobs])
                if whole:
                    yield _named(True, settled(rows, more))
                else:
                    rows, _, later, earlier, n = partners(rows, wide=more.reshape(-1, 8) if len(more) else None)
                    yield _named(False, rows[later], rows[earlier], n)

    return run


def _index(texts: DataFrame, n_parts: int, *shared) -> DataFrame:
    # A part holds the entries of about PART_WORDS words of the texts; those of a frequent word are dealt in blocks.
    sent = texts.sparkSession.sparkContext.broadcast(shared)
    gathered = texts.mapInArrow(_gather(sent, n_parts), "part int, rows binary, more binary").groupBy("part").agg(F.collect_list("rows").alias("rows"), F.collect_list("more").alias("more"))
    return gathered.mapInArrow(_meet(n_parts, shared[-1]), _MET)


def _line_texts(texts: DataFrame, wanted: bytes) -> DataFrame:
    """(at, key, line, words) of the lines that a bitmap of their codes marks."""
    shared = texts.sparkSession.sparkContext.broadcast(wanted)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ats, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, offsets = wordhash.raw(batch.column(2))
            breaks = np.flatnonzero(data == 10)
            at = np.searchsorted(offsets, breaks, "right") - 1
            texts = np.concatenate([np.arange(len(ats)), at])
            starts, ends = np.concatenate([offsets[:-1], breaks + 1]), np.concatenate([breaks, offsets[1:]])
            order = np.lexsort((starts, texts))
            ends = ends[np.lexsort((ends, np.concatenate([at, np.arange(len(ats))])))]
            text, starts = texts[order], starts[order]
            line = np.arange(len(text)) - np.searchsorted(text, text)
            own = np.flatnonzero(marked(shared.value, _codes(ats[text], keys[text], line)))
            text, line = text[own], line[own]
            found = [data[a:b].tobytes() for a, b in zip(starts[own].tolist(), ends[own].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ats[text]), pa.array(keys[text]), pa.array(line.astype(np.int32)), pa.array(found, pa.binary())], ["at", "key", "line", "words"])

    return texts.mapInArrow(run, "at long, key long, line int, words binary")


@trimmed
def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for x, y in zip(batch.column(7).to_pylist(), batch.column(8).to_pylist(), strict=True):
            a, b = set(x.lower().split()), set(y.lower().split())
            both = len(a & b)
            found.append(both >= SIMILARITY * (len(a) + len(b) - both) - 1e-9)
        yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(found, pa.bool_())], [*_NAME, *_PARTNER, "more", "late"])


_NAME = ["at", "key", "line"]
_PARTNER = ["xat", "xkey", "xline"]


def _checked(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """Each line of asked with its partner that most of its words name, late (similar) and more (it has others)."""
    votes = asked.groupBy(*_NAME, *_PARTNER).agg(F.count(F.lit(1)).alias("votes"), F.max("n").alias("n"))
    best = votes.groupBy(*_NAME).agg(F.max(F.struct("votes", *_PARTNER)).alias("x"), ((F.max("n") > 1) | (F.count(F.lit(1)) > 1)).alias("more"))
    pairs = stage(best.select(*_NAME, *(f"x.{c}" for c in _PARTNER), "more"), "line-pairs")
    ends = pairs.select(*_NAME).union(pairs.select(*_PARTNER))
    found = stage(_line_texts(texts, bitmap_of(ends, _code(*map(F.col, _NAME)))).dropDuplicates(_NAME), "line-words")
    of = lambda x, w: found.select(*(F.col(c).alias(x + c) for c in _NAME), F.col("words").alias(w))
    both = pairs.join(of("", "a"), _NAME).join(of("x", "b"), _PARTNER).select(*_NAME, *_PARTNER, "more", "a", "b")
    return stage(both.mapInArrow(_verify, "at long, key long, line int, xat long, xkey long, xline int, more boolean, late boolean"), "line-checked")


def _open(asked: DataFrame, checked: DataFrame) -> tuple[bytes, bytes] | None:
    """The lines that failed but have other partners: a bitmap of them and one of their words with fitting sizes."""
    left = checked.where("more AND NOT late").select(*_NAME, *_PARTNER)
    if left.isEmpty():
        return None
    tried = left.withColumn("tried", F.lit(True))
    words = asked.join(left.select(*_NAME), _NAME, "left_semi").join(tried, [*_NAME, *_PARTNER], "left").where("n > 1 OR tried IS NULL").select("word", "size").distinct()
    words = words.withColumn("size", F.explode(F.sequence(F.ceil(F.col("size") * SIMILARITY - 1e-9), F.floor(F.col("size") / SIMILARITY + 1e-9))))
    return bitmap_of(left, _code(*map(F.col, _NAME))), bitmap_of(words, _sized(F.col("word"), F.col("size")))


def late_lines(docs: DataFrame) -> DataFrame:
    """(at, key, line) of every line that equals or resembles an earlier one; at and key as in _keyed."""
    names = _keyed(docs)
    texts = docs.select(names["_at"].alias("at"), names["_key"].alias("key"), whole_text().alias("text"))
    levels, total = rarity(texts)
    n_parts, blocks = max(LEAST_PARTS, total // PART_WORDS), frequent(texts, levels)
    met = stage(_index(texts, n_parts, levels, blocks, None, None, False), "line-met")
    late = met.where("late").select(*_NAME)
    for whole in (False, True):
        asked = met.where("NOT late")
        checked = _checked(asked, texts)
        late = late.unionByName(checked.where("late").select(*_NAME))
        if not (left := _open(asked, checked)):
            return late.distinct()
        met = stage(_index(texts, n_parts, levels, blocks, *left, whole), "line-rest")
    return late.unionByName(met.select(*_NAME)).distinct()


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with the remaining text, n_lines and n_removed; a document of which no word is left stays as a row."""
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    docs = docs.select(*kept)
    at, key, late, may = fresh(kept, "_at", "_key", "_late", "_may")
    found = stage(late_lines(docs).groupBy("at", "key").agg(F.sort_array(F.collect_set("line")).alias(late)), "line-late").withColumnsRenamed({"at": at, "key": key})  # lines of one document
    few = (found.agg(F.sum(F.size(late))).first()[0] or 0) <= MAX_BROADCAST
    names = _keyed(docs)
    rows = docs.withColumns({at: names["_at"], key: names["_key"], "n_lines": F.size(F.split(whole_text(), "\n", -1)).cast("long")})
    rows = rows.withColumn(may, marked_by(found, key)(key))
    place = kept.index("text")

    @trimmed
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines = batch.column(place).to_pylist() if few else unsqueezed(batch.column(place)), batch.column(batch.num_columns - 2).to_pylist()
            for i, gone in enumerate(lines):
                if gone:
                    own = texts[i].split("\n")
                    for k in reversed(gone):
                        own[k] = None
                    texts[i] = "\n".join(x for x in own if x is not None)
            columns = batch.columns[:-2]
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, batch.columns[-1]], names=[*batch.schema.names[:-2], "n_removed"])

    asked = rows.where(F.col(may)).drop(may)
    hit = (asked.join(F.broadcast(found), [at, key], "left") if few else squeezed(asked).join(found, [at, key], "left")).select(*kept, "n_lines", late, F.greatest(F.size(late), F.lit(0)).cast("long").alias("n_removed"))
    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL("n_lines long, n_removed long").fields])
    done = hit.mapInArrow(cut, schema).unionByName(rows.where(~F.col(may)).select(*kept, "n_lines", F.lit(0).cast("long").alias("n_removed")))
    if "n_chars" in kept:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*kept, "n_lines", "n_removed")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.crc32(F.encode(whole_text(), "UTF-8")).alias("kept_crc32"))
