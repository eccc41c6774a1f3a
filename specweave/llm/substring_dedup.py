"""Fuzzy repeated passages: shared word k-mer seeds, chained with gap costs, then aligned.

Each text gives the winnowed minima of its word k-mer hashes as seeds, so any run of SEED + WINDOW - 1 equal
words in two texts has a common seed. The places of a seed meet in one task, in the order of the corpus (doc_id, ids
that are no integers by their hash, null last; a hash of the document; position). Places with the same AROUND words on
either side are one context, and its later places are joined to its first. The first place of a context is held
against those of all earlier contexts of the seed: the words around that agree, of four bits each, tell how far an
extension would come on either side, and it is joined to all that could give a span of LEAST_SPAN words, except those
for which another comes as far on both sides. It is also joined to the seed's first place in the corpus, whatever is
around that. So no seed is too frequent, and copies are not expanded into pairs. The anchors of a document with one
source are chained: each anchor adds its length and loses GAP for each word between it and its predecessor on either
side; a Fenwick tree over the source positions finds the best predecessor in logarithmic time. A chain's two passages
are extended at both ends while words agree, aligned within a band, and kept if similar; a chain that is not is split
at its widest gap and its parts are tried in the same way, down to runs of equal words. A chain of one or two anchors
is looked at only if the words around one of them allow a span, as such chains are mostly common phrases. Passages of
a document that follow each other, also from different sources, are merged; those of LEAST_WORDS words or more are the
result.

Defined cases: null, empty and short texts have no passage; equal rows (same doc_id and text) are one document;
repeats inside one document are not reported; ties go to the earlier source; an empty table gives an empty
result; other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specweave.llm import wordhash
from specweave.llm.common import documents, marked, marked_by, small_batches, squeezed, stage, trimmed, unsqueezed, whole_text
from specweave.llm.line_dedup import order_of, packed, unpacked
from specweave.llm.near_dedup import _mix, _POWERS, aligned

SEED, WINDOW = 4, 4
#: Bits of the bitmap of seeds that occur twice: 16 MB whatever the input.
SEED_BITS = 1 << 27
#: Bits of it that are marked at once.
PART_BITS = 1 << 16
#: Loss per word of distance between chained anchors, on each side.
GAP = 0.1
LEAST_ANCHORS = 1
#: A chain of fewer anchors than so many needs one whose AROUND words on either side allow a span.
SURE_ANCHORS, AROUND = 3, 16
#: Words of a span, at least, to be part of a passage: shorter ones are common phrases.
LEAST_SPAN = 16
#: Share of the longer passage that must be aligned.
SIMILARITY = 0.8
LEAST_WORDS = 45
#: Passages at most so many words apart are one.
JOIN_GAP = 8
#: Passages are cut out with this margin, on borders that are multiples of it.
MARGIN = 32
#: While extending: gain, loss, and the drop at which to stop.
MATCH, MISMATCH, DROP = 1, 2, 8
#: Pairs of places looked at at once; a place with more partners than MANY is looked at alone.
AT_ONCE, MANY = 1 << 18, 512
#: Seeds for each part in which places meet, and parts at least.
PART_SEEDS, LEAST_PARTS = 500_000, 64
#: A place of a seed: the document (its order and hash), the position, and what is around.
PLACE = np.dtype([("seed", "<u8"), ("before", "<u8"), ("behind", "<u8"), ("at", "<i8"), ("key", "<u8"), ("pos", "<u4")])
#: A place (key, pos) and one of an earlier document (source, from); like: what is around allows a span.
ANCHOR = np.dtype([("key", "<u8"), ("source", "<u8"), ("pos", "<u4"), ("from", "<u4"), ("like", "u1")])


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split()


def surroundings(words: wordhash.Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Four bits of each of the AROUND words before and of those behind the seeds at these places; 0 beyond a text.

    The first bits of all words come first, then the second ones, so what differs folds to a bit a word.
    """
    code = np.zeros(len(words.h) + AROUND * len(words.first) + AROUND + SEED, np.uint64)
    h = words.h >> np.uint64(9)
    code[np.arange(len(h)) + AROUND * (words.text + 1)] = sum((h >> np.uint64(k) & np.uint64(1)) << np.uint64(AROUND * k) for k in range(4))
    n = 1
    while n < AROUND:
        code = code[:-n] | code[n:] << np.uint64(n)
        n *= 2
    at = at + AROUND * words.text[at]
    return code[at], code[at + AROUND + SEED]


def _extents(a: np.ndarray, b: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """How far an extension comes between what is around on one side."""
    x = a ^ b
    x |= x >> np.uint64(2 * AROUND)
    x |= x >> np.uint64(AROUND)
    return reach[x.astype(np.uint16)]


def _reach(behind: bool) -> np.ndarray:
    """What _extension gives for each pattern of words that differ, the nearest in the lowest bit if behind."""
    masks = ~np.arange(1 << AROUND)
    total, best, at, going = (np.zeros(len(masks), np.int64) for _ in range(4))
    for i in range(AROUND):
        total += np.where(masks >> (i if behind else AROUND - 1 - i) & 1, MATCH, -MISMATCH)
        better = (going == 0) & (total > best)
        best[better], at[better] = total[better], i + 1
        going |= best - total >= DROP
    return at.astype(np.int16)


def _farthest(left: np.ndarray, right: np.ndarray) -> list[int]:
    """The first of those that come farthest to the left, then of those that come farther to the right than it, and so on."""
    out, sums = [], left + right + SEED
    code = np.where(sums >= LEAST_SPAN, left * (AROUND + 1) + right + 1, 0)
    while code[i := int(code.argmax())]:
        out.append(i)
        code[right <= right[i]] = 0
    return out


def seeds_of(words: wordhash.Words) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places among all words) of the winnowed seeds of each text."""
    n = len(words.h) - SEED + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for i in range(SEED):
        h = _mix(h + words.h[i : i + n] * _POWERS[i % len(_POWERS)] + np.uint64(i))
    counts = np.diff(words.first) - SEED + 1  # seeds of each text
    last = (words.first[1:] - SEED)[words.text[:n]]  # the last one of the text that a seed begins in
    chosen = np.zeros(n, bool)
    if n >= WINDOW:
        least, place = h[: n - WINDOW + 1], np.arange(n - WINDOW + 1)
        whole = place + WINDOW - 1 <= last[: len(place)]
        for i in range(1, WINDOW):
            less = h[i : i + len(place)] < least
            least, place = np.where(less, h[i : i + len(place)], least), np.where(less, np.arange(i, i + len(place)), place)
        chosen[place[whole]] = True
    for t in np.flatnonzero((counts > 0) & (counts < WINDOW)).tolist():
        chosen[words.first[t] + h[words.first[t] : words.first[t] + counts[t]].argmin()] = True
    at = np.flatnonzero(chosen)
    return h[at].view(np.int64), at


def chains(anchors: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Best disjoint collinear chains of (position, source position) anchors, best first."""
    order = sorted(anchors, key=lambda a: (a[0], -a[1]))
    rank = {y: i + 1 for i, y in enumerate(sorted({y for _, y in order}))}
    size = len(rank)
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (size + 1)
    score, parent = [0.0] * len(order), [-1] * len(order)
    for i, (x, y) in enumerate(order):
        best, k = (-1e18, -1), rank[y] - 1
        while k:
            if tree[k] > best:
                best = tree[k]
            k &= k - 1
        gain = best[0] - GAP * (x + y)
        score[i] = SEED + max(0.0, gain)
        parent[i] = best[1] if gain > 0 else -1
        entry, k = (score[i] + GAP * (x + y), i), rank[y]
        while k <= size:
            if entry > tree[k]:
                tree[k] = entry
            k += k & -k
    used, out = [False] * len(order), []
    for i in sorted(range(len(order)), key=lambda i: (-score[i], i)):
        chain, j = [], i
        while j >= 0 and not used[j]:
            used[j] = True
            chain.append(order[j])
            j = parent[j]
        if len(chain) >= LEAST_ANCHORS:
            out.append(chain[::-1])
    return out


def runs_of(chain: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, source start, words) of a chain's stretches of anchors that touch on one diagonal: equal words."""
    out: list[tuple[int, int, int]] = []
    for x, y in chain:
        if out and x - y == out[-1][0] - out[-1][1] and x <= out[-1][0] + out[-1][2]:
            out[-1] = (*out[-1][:2], x + SEED - out[-1][0])
        else:
            out.append((x, y, SEED))
    return out


def passages(a: list[bytes], b: list[bytes], runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, float]]:
    """Similar spans of a chain's runs: all of it, or else what its parts on either side of the widest gap give."""
    out, todo = [], [runs]
    while todo:
        part = todo.pop()
        (x, y, _), (u, v, n) = part[0], part[-1]
        span = align(a, b, x, u + n, y, v + n)
        if span[4] < SIMILARITY and len(part) > 1:
            gaps = [max(q[0] - p[0], q[1] - p[1]) - p[2] for p, q in zip(part, part[1:], strict=False)]
            at = max(range(len(gaps)), key=lambda i: (gaps[i], min(i, len(gaps) - i))) + 1
            todo += [part[at:], part[:at]]
            continue
        if span[4] < SIMILARITY:  # equal words with too few around them
            span = align(a, b, x, u + n, y, v + n, exact=True)
        if span[1] - span[0] >= LEAST_SPAN:
            out.append(span)
    return out


def _extension(pairs) -> int:
    """How many word pairs to add from an end: the best sum before it drops by DROP."""
    best, total, at = 0, 0, 0
    for i, (a, b) in enumerate(pairs):
        total += MATCH if a == b else -MISMATCH
        if total > best:
            best, at = total, i + 1
        elif best - total >= DROP:
            break
    return at


def _equal(pairs) -> int:
    return sum(1 for _ in takewhile(lambda p: p[0] == p[1], pairs))


def align(a: list[bytes], b: list[bytes], a0: int, a1: int, b0: int, b1: int, exact: bool = False) -> tuple[int, int, int, int, float]:
    """Extended borders (exact: by equal words only) of the chained spans a[a0:a1], b[b0:b1] and their aligned share."""
    extension = _equal if exact else _extension
    left = extension(zip(reversed(a[:a0]), reversed(b[:b0]), strict=False))
    right = extension(zip(a[a1:], b[b1:], strict=False))
    a0, b0, a1, b1 = a0 - left, b0 - left, a1 + right, b1 + right
    x, y = a[a0:a1], b[b0:b1]
    if x == y:
        return a0, a1, b0, b1, 1.0
    number: dict[bytes, int] = {}
    codes = [[number.setdefault(w, len(number)) for w in s] for s in (x, y)]
    longer = max(len(x), len(y))
    return a0, a1, b0, b1, aligned(*codes, abs(len(x) - len(y)) + longer // 5 + 1) / longer


@trimmed
def _low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lower 32 bits of a batch's seeds, each at most twice, by their part of the bitmap."""
    for batch in batches:
        found = [seeds_of(wordhash.words(texts))[0] for _, texts in wordhash.parts(batch.column(0))]
        low = np.concatenate([np.zeros(0, np.int64), *found]).astype(np.uint32)
        high = np.uint32(32 - (SEED_BITS - 1).bit_length())
        low = np.sort(low << high | low >> np.uint32(32) - high)  # by part
        again = np.concatenate([[False], low[1:] == low[:-1]])[: len(low)]
        low = low[~again | np.concatenate([[False], again[1:] & ~again[:-1]])[: len(low)]]
        low = low >> high | low << np.uint32(32) - high
        part = (low & np.uint32(SEED_BITS - 1)) // PART_BITS
        at = np.flatnonzero(np.diff(part, prepend=-1))
        yield pa.RecordBatch.from_arrays([pa.array(part[at].astype(np.int32)), pa.array([x.tobytes() for x in np.split(low, at[1:])] if len(low) else [], pa.binary())], ["part", "low"])


@trimmed
def _twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bits of the seeds that occur twice in a part, and how many seeds it has."""
    for batch in batches:
        maps, n = [], []
        for listed in batch.column(1).to_pylist():
            low = np.sort(np.frombuffer(b"".join(listed), np.uint32))
            n.append(len(low))
            bits = np.zeros(PART_BITS, bool)
            bits[low[1:][low[1:] == low[:-1]] % PART_BITS] = True
            maps.append(np.packbits(bits, bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(maps, pa.binary()), pa.array(n, pa.int64())], ["part", "map", "n"])


def _dealt(rows: np.ndarray, key: np.ndarray, n_parts: int) -> pa.RecordBatch:
    """The rows packed by part, which their key tells."""
    part = (wordhash.mix(key) % np.uint64(n_parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    rows, part = rows[order], part[order]
    at = np.flatnonzero(np.diff(part, prepend=-1))
    blobs = [packed(x) for x in np.split(rows, at[1:])] if len(rows) else []
    return pa.RecordBatch.from_arrays([pa.array(part[at]), pa.array(blobs, pa.binary())], ["part", "rows"])


def _gathered(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> Iterator[np.ndarray]:
    """The rows of each part."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield np.concatenate([unpacked(x, kind) for x in batch.column(0)[k].as_py()])


def _places(shared, n_parts: int):
    """The seeds of a text, with their places and what is around, that may occur twice, by part."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ats, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for lo, texts in wordhash.parts(batch.column(2), size=32 * wordhash.PIECE):
                words = wordhash.words(texts)
                h, at = seeds_of(words)
                may = marked(shared.value, h)
                h, at = h[may], at[may]
                text = words.text[at]
                rows = np.zeros(len(h), PLACE)
                rows["seed"], rows["at"], rows["key"], rows["pos"] = h.view(np.uint64), ats[lo + text], keys[lo + text], at - words.first[text]
                rows["before"], rows["behind"] = surroundings(words, at)
                yield _dealt(rows, rows["seed"], n_parts)

    return run


def anchors_of(rows: np.ndarray) -> np.ndarray:
    """The anchors of the places of seeds: each with the first of its context or, if it is that, with those of earlier ones."""
    rows = rows[np.lexsort((rows["pos"], rows["key"], rows["at"], rows["seed"]))]
    seed, key, pos = rows["seed"].copy(), rows["key"].copy(), rows["pos"].copy()
    again = (seed[1:] == seed[:-1]) & (key[1:] == key[:-1]) & (pos[1:] == pos[:-1])  # of equal rows
    single = np.concatenate([[True], seed[1:] != seed[:-1]]) & np.concatenate([seed[1:] != seed[:-1], [True]])
    kept = np.flatnonzero(~single & ~np.concatenate([[False], again]))
    seed, key, pos = seed[kept], key[kept], pos[kept]
    before, behind = rows["before"][kept], rows["behind"][kept]
    if not len(kept):
        return np.zeros(0, ANCHOR)
    along = np.arange(len(kept))
    group = np.cumsum(np.concatenate([[False], seed[1:] != seed[:-1]]))
    head = np.flatnonzero(np.diff(group, prepend=-1))[group]
    _, first, context = np.unique(wordhash.mix(wordhash.mix(wordhash.mix(seed) + before) + behind), return_index=True, return_inverse=True)
    first = first[context]
    own = key[first] == key  # a document that repeats itself looks for others at each of its places
    later, earlier, like = [along[~own]], [first[~own]], [np.ones((~own).sum(), bool)]
    far = np.flatnonzero(own & (key != key[head]))
    later, earlier, like = [*later, far], [*earlier, head[far]], [*like, np.zeros(len(far), bool)]
    met = np.flatnonzero(first == along)
    begin = np.searchsorted(met, head)
    n = np.where(own, np.searchsorted(met, along) - begin, 0)
    looks = np.flatnonzero(n)
    for j in looks[n[looks] >= MANY].tolist():
        here = met[begin[j] : begin[j] + n[j]]
        here = here[key[here] != key[j]]
        i = here[_farthest(_extents(before[here], before[j], _BEFORE), _extents(behind[here], behind[j], _BEHIND))] if len(here) else here
        later.append(np.full(len(i), j))
        earlier.append(i)
        like.append(np.ones(len(i), bool))
    looks = looks[n[looks] < MANY]
    total, lo = np.cumsum(n[looks]), 0
    while lo < len(looks):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + AT_ONCE, "right")))
        mine = looks[lo:hi]
        lo = hi
        of = np.repeat(np.arange(len(mine)), n[mine])
        j = mine[of]
        i = met[np.arange(len(j)) - np.repeat(np.cumsum(n[mine]) - n[mine], n[mine]) + begin[j]]
        left, right = _extents(before[i], before[j], _BEFORE), _extents(behind[i], behind[j], _BEHIND)
        fit = np.flatnonzero((left + right + SEED >= LEAST_SPAN) & (key[i] != key[j]))
        of, i, left, right = of[fit], i[fit], left[fit].astype(np.int64), right[fit].astype(np.int64)
        # By place, from the farthest to the left on; those stay that come farther to the right than all before.
        rank = np.sort(of << 42 | AROUND - left << 37 | AROUND - right << 32 | i)
        of, i, right = rank >> 42, rank & (1 << 32) - 1, AROUND - (rank >> 32 & 31)
        reached = of * (AROUND + 2) + right + 1
        best = np.flatnonzero(reached > np.concatenate([[-1], np.maximum.accumulate(reached)[:-1]])[: len(reached)])
        later.append(mine[of[best]])
        earlier.append(i[best])
        like.append(np.ones(len(best), bool))
    later, earlier, like = map(np.concatenate, (later, earlier, like))
    order = np.lexsort((~like, earlier, later))
    later, earlier, like = later[order], earlier[order], like[order]
    new = np.concatenate([[True], (later[1:] != later[:-1]) | (earlier[1:] != earlier[:-1])])[: len(later)]
    later, earlier, like = later[new], earlier[new], like[new]
    out = np.zeros(len(later), ANCHOR)
    out["key"], out["source"], out["pos"], out["from"], out["like"] = key[later], key[earlier], pos[later], pos[earlier], like
    return out


def _meet(n_parts: int):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _gathered(batches, PLACE):
            found = anchors_of(rows)
            yield _dealt(found, found["key"], n_parts)

    return run


@trimmed
def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for found in _gathered(batches, ANCHOR):
        found = found[np.lexsort((found["from"], found["pos"], found["source"], found["key"]))]
        ends = np.flatnonzero(np.concatenate([(found["key"][1:] != found["key"][:-1]) | (found["source"][1:] != found["source"][:-1]), [True]])) + 1
        starts = np.concatenate([[0], ends[:-1]])
        kept = (ends - starts >= SURE_ANCHORS) | (np.maximum.reduceat(found["like"], starts) > 0)
        pos, source, likes = found["pos"].tolist(), found["from"].tolist(), found["like"].tolist()
        at, rows, runs = [], [], []
        for lo, hi in zip(starts[kept].tolist(), ends[kept].tolist(), strict=True):
            like = {pos[i] for i in range(lo, hi) if likes[i]}
            for c in chains(list(zip(pos[lo:hi], source[lo:hi], strict=True))):
                if len(c) < SURE_ANCHORS and like.isdisjoint(x for x, _ in c):
                    continue
                a0, a1, b0, b1 = c[0][0], c[-1][0] + SEED, c[0][1], c[-1][1] + SEED
                cut = [max(0, a0 - MARGIN) // MARGIN * MARGIN, -(-(a1 + MARGIN) // MARGIN) * MARGIN, max(0, b0 - MARGIN) // MARGIN * MARGIN, -(-(b1 + MARGIN) // MARGIN) * MARGIN]
                at.append(lo)
                rows.append(cut)
                runs.append([v for run in runs_of(c) for v in run])
        named = found[np.array(at, np.int64)]
        columns = np.array(rows, np.int32).reshape(-1, 4).T
        yield pa.RecordBatch.from_arrays([*(pa.array(named[k].astype(np.int64)) for k in ("key", "source")), *map(pa.array, columns), pa.array(runs, pa.list_(pa.int32()))], ["key", "source_key", "ca", "da", "cb", "db", "runs"])


@trimmed
def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, text, spans in zip(batch.column(0).to_pylist(), unsqueezed(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            own = words_of(text)
            rows += [(key, s["c"], s["d"], b" ".join(own[s["c"] : s["d"]])) for s in spans]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["key", "c", "d", "words"])


@trimmed
def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, rows = [], []
        for i, r in enumerate(batch.select(["ca", "cb", "runs", "wa", "wb"]).to_pylist()):
            flat = iter(r["runs"])
            runs = [(x - r["ca"], y - r["cb"], n) for x, y, n in zip(flat, flat, flat, strict=True)]
            for a0, a1, b0, b1, share in passages(r["wa"].split(), r["wb"].split(), runs):
                at.append(i)
                rows.append((a0 + r["ca"], a1 + r["ca"], b0 + r["cb"], b1 + r["cb"], share))
        took = [batch.column(c).take(pa.array(at, pa.int64())) for c in ("key", "source_key")]
        yield pa.RecordBatch.from_arrays([*took, *(pa.array([x[i] for x in rows], pa.int64()) for i in range(4)), pa.array([x[4] for x in rows], pa.float64())], ["key", "source_key", "a0", "a1", "b0", "b1", "similarity"])


def merge(spans: list[dict]) -> list[dict]:
    """Passages of one document: overlapping or near spans joined; source and similarity of the longest span."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: (s["a0"], -s["a1"], s["at"], s["source_key"], s["b0"])):
        if out and s["a0"] <= out[-1]["a1"] + JOIN_GAP:
            last = out[-1]
            if s["a1"] - s["a0"] > last["longest"]:
                last |= {k: s[k] for k in ("source", "at", "source_key", "b0", "b1", "similarity")} | {"longest": s["a1"] - s["a0"]}
            last["a1"] = max(last["a1"], s["a1"])
        else:
            out.append(dict(s, longest=s["a1"] - s["a0"]))
    return [s for s in out if s["a1"] - s["a0"] >= LEAST_WORDS]


_BEFORE, _BEHIND = _reach(False), _reach(True)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, start_word, n_words, source_doc_id, source_start, similarity of every passage that an earlier document has."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), whole_text())
    names = docs.select("doc_id", order_of(docs).alias("at"), key.alias("key"))
    texts = docs.select(order_of(docs).alias("at"), key.alias("key"), whole_text().alias("text"))
    # Seeds are computed twice rather than written. By chance a lone seed is marked too.
    by_part = lambda rows, column: rows.groupBy("part").agg(F.collect_list(column).alias(column))
    twice = by_part(texts.select("text").mapInArrow(_low, "part int, low binary"), "low").mapInArrow(_twice, "part int, map binary, n long")
    bits, total = np.zeros(SEED_BITS // 8, np.uint8), 0
    with small_batches(docs.sparkSession):
        maps = twice.collect()  # SEED_BITS / 8 bytes at most
    for part, found, n in maps:
        bits[part * PART_BITS // 8 : (part + 1) * PART_BITS // 8] = np.frombuffer(found, np.uint8)
        total += n
    shared, n_parts = docs.sparkSession.sparkContext.broadcast(bits.tobytes()), max(LEAST_PARTS, total // PART_SEEDS)
    places = by_part(texts.mapInArrow(_places(shared, n_parts), "part int, rows binary"), "rows").select("rows")  # about PART_SEEDS, or all of one seed
    anchors = by_part(places.mapInArrow(_meet(n_parts), "part int, rows binary"), "rows").select("rows")
    found = stage(anchors.mapInArrow(_chain, "key long, source_key long, ca int, da int, cb int, db int, runs array<int>"), "sub-chains")
    side = lambda k, c, d: found.select(F.col(k).alias("key"), F.struct(F.col(c).alias("c"), F.col(d).alias("d")).alias("span"))
    wanted = side("key", "ca", "da").unionByName(side("source_key", "cb", "db")).distinct()
    wanted = stage(wanted.groupBy("key").agg(F.collect_list("span").alias("spans")), "sub-wanted")  # distinct spans of one document
    asked = marked_by(wanted, "key")
    slices = squeezed(texts.where(asked("key")).select("key", "text")).join(wanted, "key").mapInArrow(_cut, "key long, c int, d int, words binary")
    slices = stage(slices.dropDuplicates(["key", "c", "d"]), "sub-slices")
    of = lambda k, c, d, w: slices.select(F.col("key").alias(k), F.col("c").alias(c), F.col("d").alias(d), F.col("words").alias(w))
    both = found.join(of("key", "ca", "da", "wa"), ["key", "ca", "da"]).join(of("source_key", "cb", "db", "wb"), ["source_key", "cb", "db"])
    spans = "key long, source_key long, a0 long, a1 long, b0 long, b1 long, similarity double"
    good = stage(both.select("key", "source_key", "ca", "cb", "runs", "wa", "wb").mapInArrow(_align, spans), "sub-spans")
    known = names.where(marked_by(good.select("key").union(good.select("source_key")), "key")("key")).dropDuplicates(["key"])
    known = stage(known, "sub-names")
    named = good.join(known.select(F.col("key").alias("source_key"), F.col("doc_id").alias("source"), "at"), "source_key")
    own = named.groupBy("key").agg(F.collect_list(F.struct("source", "at", "source_key", "a0", "a1", "b0", "b1", "similarity")).alias("spans")).join(known, "key")  # spans of one document

    @trimmed
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, spans in enumerate(batch.column(1).to_pylist()):
                for s in merge(spans):
                    at.append(i)
                    rows.append(s)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at, pa.int64())), pa.array([s["a0"] for s in rows], pa.int64()), pa.array([s["a1"] - s["a0"] for s in rows], pa.int64()),
                    pa.array([s["source"] for s in rows], batch.schema.field(0).type), pa.array([s["b0"] for s in rows], pa.int64()), pa.array([s["similarity"] for s in rows], pa.float64()),
                ],
                ["doc_id", "start_word", "n_words", "source_doc_id", "source_start", "similarity"],
            )

    return own.select("doc_id", "spans").mapInArrow(join, f"doc_id {kind}, start_word long, n_words long, source_doc_id {kind}, source_start long, similarity double")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir))
