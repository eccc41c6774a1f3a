"""Language-model scoring: a causal self-attention model in numpy over subword ids, beside a word-count base.

Training documents are those whose crc32(doc_id as text) mod 7 is not 2. All their words are counted in Spark, by
64-bit hashes. Every text is encoded once; ids and texts are written. The whole training texts are cut into
consecutive windows of ids, in which each id and the end is predicted once; ids are counted over all of them, and
the weights are trained where the windows lie by Adagrad (each task keeps its own state over all of its windows)
and averaged after each round, in two steps, so the driver holds TRAINERS small weight sets at most.

The model: an embedding per id bucket plus one per position, one causal attention head, a residual sum and a
softmax in two steps, over groups of classes and over the classes of a group; frequent ids are classes of their
own, rarer ones share classes of equal mass, in which an id has its smoothed share. So every text has a proper
probability. A text is read in overlapping windows; each window scores the ids after its overlap, so each id (and
the end) is scored once, with at least OVERLAP ids of context where the text has them. Windows of many texts go
through masked attention as one batch.

Logs of the counts of frequent words (at most HEAVY) are broadcast; all others are joined by shuffle, so the base is
exact at any vocabulary size. As the weights of tasks are averaged, score depends on how the rows are dealt.

Defined cases: a null or empty text is the end alone; a null doc_id counts as the text "" for the split; repeated
rows are scored (and counted) each; without training documents N and V are 0 and the model is uniform over its
classes; an empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specweave.llm import wordhash
from specweave.llm.common import documents, small_batches, stage, trimmed, whole_text
from specweave.llm.subwords import subwords, tokenizer_path

FOLDS, HELD_OUT = 7, 2
IDS, END = 50_257, 50_256
LENGTH, OVERLAP = 32, 6
WIDTH, BUCKETS, OWN_BUCKETS = 8, 4096, 3072
#: Classes are CLASSES, in groups of GROUP; OWN_CLASSES of them have one id.
CLASSES, OWN_CLASSES, GROUP = 256, 208, 16
GROUPS = CLASSES // GROUP
ROUNDS, BATCH, RATE, TRAINERS = 1, 256, 0.2, 256
#: Words whose counts are broadcast, at most; of those that fall on one of the slots the most frequent, the rest are joined.
HEAVY, SLOT_BITS = 1_000_000, 21
#: Distinct words a task holds before it passes their counts on.
HELD = 400_000
#: Windows in one batch of attention.
AT_ONCE = 256
#: The hash that stands for the end of a text among the words.
_END_WORD = -1


def is_training(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS != HELD_OUT


# --- the model -----------------------------------------------------------------------------------------------


def tables(counts: np.ndarray) -> dict:
    """Buckets, classes and the share of each id in its class, from id counts."""
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(IDS, np.int64)
    rank[order] = np.arange(IDS)
    bucket = np.where(rank < OWN_BUCKETS, rank, OWN_BUCKETS + np.arange(IDS) % (BUCKETS - OWN_BUCKETS)).astype(np.int32)
    mass = counts[order] + 1.0
    tail = np.cumsum(mass[OWN_CLASSES:])
    cls = np.empty(IDS, np.int32)
    cls[order[:OWN_CLASSES]] = np.arange(OWN_CLASSES)
    cls[order[OWN_CLASSES:]] = OWN_CLASSES + np.minimum(CLASSES - OWN_CLASSES - 1, (tail - mass[OWN_CLASSES:]) / tail[-1] * (CLASSES - OWN_CLASSES)).astype(np.int32)
    total = np.bincount(cls, counts + 1.0, CLASSES)
    # A class without an id (one id may hold more than a class's mass) keeps a little, so that its group is proper.
    prior = np.log(np.maximum(total, 1e-9) / total.sum())
    return {"bucket": bucket.astype(np.uint16), "class": cls.astype(np.uint8), "share": np.log((counts + 1.0) / total[cls]), "prior": prior}


def start(prior: np.ndarray) -> dict[str, np.ndarray]:
    rng, d = np.random.default_rng(11), WIDTH
    w = {"e": rng.normal(0, 0.3, (BUCKETS, d)), "p": rng.normal(0, 0.05, (LENGTH, d))}
    w |= {k: rng.normal(0, d**-0.5, (d, d)) for k in ("q", "k", "v", "o")}
    own = prior.reshape(GROUPS, GROUP)
    group = np.log(np.exp(own).sum(1))
    w |= {"u": np.zeros((d, GROUPS)), "c": group, "U": np.zeros((GROUPS, d, GROUP)), "C": own - group[:, None]}
    return {k: x.astype(np.float32) for k, x in w.items()}


_SEEN = np.tril(np.ones((LENGTH, LENGTH), np.float32))
#: Scores are held to this, so their exponentials stay finite.
_MOST = 60.0


def _bounded(s: np.ndarray) -> np.ndarray:
    """s held to _MOST, in place; mostly it is, and a maximum is found sooner than each value is compared."""
    return np.minimum(s, _MOST, out=s) if s.max(initial=-np.inf) > _MOST else s


def _times(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """x @ m as one product of two matrices."""
    return (x.reshape(-1, x.shape[-1]) @ m).reshape(*x.shape[:-1], m.shape[-1])


def _attention(w: dict, x: np.ndarray, skip: int = 0):
    """(scaled queries, keys, values, masked exponentials) of a batch of windows x (n, LENGTH, WIDTH), for places from skip on."""
    q, k, v = _times(x[:, skip:], w["q"] * WIDTH**-0.5), _times(x, w["k"]), _times(x, w["v"])
    a = _bounded(q @ k.transpose(0, 2, 1))
    np.exp(a, out=a)
    a *= _SEEN[skip:]
    return q, k, v, a


def attend(w: dict, x: np.ndarray):
    """(scaled queries, keys, values, attention, mixed values) of a batch of windows x (n, LENGTH, WIDTH)."""
    q, k, v, a = _attention(w, x)
    a *= (1 / _sums(a))[..., None]
    return q, k, v, a, a @ v


def mixed(w: dict, x: np.ndarray, skip: int = 0) -> np.ndarray:
    """The mixed values alone; a column of ones sums the weights along the way."""
    _, _, v, a = _attention(w, x, skip)
    z = a @ np.concatenate([v, np.ones((*v.shape[:-1], 1), v.dtype)], -1)
    return z[..., :-1] / z[..., -1:]


def _by_group(target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in order of the groups of their target classes, and where each group begins and ends."""
    group = target // GROUP  # of 8 bits, so sorted by their values
    order = np.argsort(group, kind="stable")
    return order, np.searchsorted(group[order], np.arange(GROUPS + 1))


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums along the last, short axis, as a product."""
    return x @ np.ones(x.shape[-1], x.dtype)


def _down(x: np.ndarray) -> np.ndarray:
    """Sums of the rows, as a product."""
    return np.ones(len(x), x.dtype) @ x


def _scores(h: np.ndarray, u: np.ndarray, c: np.ndarray) -> np.ndarray:
    s = h @ u
    s += c
    return _bounded(s)


def log_probabilities(w: dict, x: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log probabilities of the target classes at each position; of the last ones, where there are fewer targets."""
    skip, flat = x.shape[1] - target.shape[1], target.ravel()
    h = (x[:, skip:] + _times(mixed(w, x, skip), w["o"])).reshape(-1, WIDTH)
    order, ends = _by_group(flat)
    ordered, begin = flat.take(order), np.arange(len(flat)) * GROUP
    h, own = h.take(order, 0), begin + ordered % GROUP
    s = _scores(h, w["u"], w["c"])
    got = s.ravel().take(begin + ordered // GROUP)
    got -= np.log(_sums(np.exp(s, out=s)))
    for g in range(GROUPS):
        here = slice(ends[g], ends[g + 1])
        s[here] = h[here] @ w["U"][g]
        s[here] += w["C"][g]
    s = _bounded(s)
    got += s.ravel().take(own)
    got -= np.log(_sums(np.exp(s, out=s)))
    out = np.empty_like(got)
    out[order] = got
    return out.reshape(target.shape)


def gradients(w: dict, buckets: np.ndarray, target: np.ndarray, there: np.ndarray) -> dict:
    """Of the mean negative log likelihood over the marked positions; that of e as (rows, values)."""
    x = w["e"].take(buckets, 0) + w["p"]
    q, k, v, a, z = attend(w, x)
    flat, there = target.ravel(), np.flatnonzero(there)
    order, ends = _by_group(flat.take(there))
    order = there.take(order)
    ordered, begin = flat.take(order), np.arange(len(order)) * GROUP
    h, group, own = (x + _times(z, w["o"])).reshape(-1, WIDTH).take(order, 0), begin + ordered // GROUP, begin + ordered % GROUP
    weight = np.float32(1 / max(1, len(order)))

    def excess(s: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Probabilities less 1 at the target, weighted."""
        np.exp(s, out=s)
        s *= (weight / _sums(s))[:, None]
        s.ravel()[own] -= weight  # a place each
        return s

    g = excess(_scores(h, w["u"], w["c"]), group)
    out = {"u": h.T @ g, "c": _down(g), "U": np.zeros_like(w["U"]), "C": np.zeros_like(w["C"])}
    d = g @ w["u"].T
    for i in range(GROUPS):
        here = slice(ends[i], ends[i + 1])
        g[here] = h[here] @ w["U"][i]
        g[here] += w["C"][i]
    g = excess(_bounded(g), own)
    for i in range(GROUPS):
        here = slice(ends[i], ends[i + 1])
        out["U"][i], out["C"][i] = h[here].T @ g[here], _down(g[here])
        d[here] += g[here] @ w["U"][i].T
    dh = np.zeros((x.size // WIDTH, WIDTH), x.dtype)
    dh[order] = d
    dh = dh.reshape(x.shape)
    outer = lambda m, n: m.reshape(-1, m.shape[-1]).T @ n.reshape(-1, n.shape[-1])
    dz = _times(dh, w["o"].T)
    da = dz @ v.transpose(0, 2, 1)
    da -= _sums(dz * z)[..., None]  # z is a @ v, so this is the sum of da * a
    da *= a
    dq, dk, dv = da @ k, da.transpose(0, 2, 1) @ q, a.transpose(0, 2, 1) @ dz
    scale = WIDTH**-0.5
    dx = dh + _times(dq, w["q"].T * scale) + _times(dk, w["k"].T) + _times(dv, w["v"].T)
    out |= {"p": _down(dx.reshape(len(dx), -1)).reshape(w["p"].shape), "q": outer(x, dq) * scale, "k": outer(x, dk), "v": outer(x, dv), "o": outer(z, dh)}
    order = np.argsort(buckets.ravel(), kind="stable")
    rows = buckets.ravel().take(order)
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    return out | {"e": (rows.take(first), np.add.reduceat(dx.reshape(-1, WIDTH).take(order, 0), first))}


def train_here(w: dict, t: dict, windows: np.ndarray, seen: dict, seed: int = 0) -> None:
    """One pass of Adagrad over windows (n, LENGTH + 1) of ids, in place; -1 marks what a short text lacks."""
    for i in np.array_split(np.random.default_rng(seed).permutation(len(windows)), max(1, len(windows) // BATCH)):
        ids = windows.take(i, 0)
        there = ids[:, 1:] >= 0
        ids = np.where(ids < 0, END, ids)
        for k, g in gradients(w, t["bucket"].take(ids[:, :-1]), t["class"].take(ids[:, 1:]), there).items():
            if k == "e":
                rows, g = g
                so_far = seen[k].take(rows, 0) + g * g
                seen[k][rows] = so_far
                w[k][rows] = w[k].take(rows, 0) - RATE * g / np.sqrt(so_far)
            else:
                seen[k] += g * g
                w[k] -= RATE * g / np.sqrt(seen[k])


def unseen(w: dict) -> dict[str, np.ndarray]:
    """Adagrad's state before any step."""
    return {k: np.full_like(x, 1e-3) for k, x in w.items()}


def score_all(w: dict, t: dict, coded: list[np.ndarray]) -> list[float]:
    """log10 probabilities of texts given as id arrays, ends included."""
    stride = LENGTH - OVERLAP
    # Each text begins with an end and is filled up with ends behind its own to whole windows.
    sizes = np.array([len(x) + 1 for x in coded])
    windows = np.maximum(1, -(-(sizes - OVERLAP) // stride))
    room = windows * stride + OVERLAP + 1
    base = np.cumsum(room) - room
    flat = np.full(room.sum(), END, np.int32)
    for lo, ids in zip((base + 1).tolist(), coded, strict=True):
        flat[lo : lo + len(ids)] = ids
    bucket, target, share = t["bucket"].take(flat), t["class"].take(flat), t["share"].take(flat)
    of = np.repeat(np.arange(len(coded)), windows)
    first = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    starts, out, along = base[of] + first * stride, np.zeros(len(coded)), np.arange(LENGTH)
    # Which of a window's places count: those behind the overlap with the one before, within the text.
    hi_of = np.minimum(sizes[of] - first * stride, LENGTH)
    for skip, chosen in ((0, np.flatnonzero(first == 0)), (OVERLAP, np.flatnonzero(first))):
        for lo in range(0, len(chosen), AT_ONCE):
            here = chosen[lo : lo + AT_ONCE]
            place = starts[here, None] + along
            after = place[:, skip:] + 1
            got = log_probabilities(w, w["e"].take(bucket.take(place), 0) + w["p"], target.take(after)) + share.take(after)
            got[along[skip:] >= hi_of[here, None]] = 0
            out += np.bincount(of[here], got.sum(1), len(coded))
    return (out / np.log(10)).tolist()


# --- the corpus ----------------------------------------------------------------------------------------------


def windows_of(ids: np.ndarray) -> np.ndarray:
    """Consecutive windows (n, LENGTH + 1) of a text's ids and end, each first id the one before; -1 after the end."""
    n = len(ids) // LENGTH + 1
    flat = np.full(n * LENGTH + 1, -1, "<i4")
    flat[0], flat[1 : len(ids) + 1], flat[len(ids) + 1] = END, ids, END
    return np.lib.stride_tricks.sliding_window_view(flat, LENGTH + 1)[::LENGTH]


def _encode(path: str):
    """Of each text: whether it is for training, and its ids as 16-bit numbers; and the word counts of those that are."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, held, row = subwords(path), [], TaskContext.get().partitionId() << 40
        names = ["doc_id", "row", "text", "training", "ids", "word", "n"]

        def told(kind: pa.DataType, held: list) -> Iterator[pa.RecordBatch]:
            words, n = merged(held)
            for lo in range(0, len(words), HELD):
                own = pa.array(words[lo : lo + HELD].view(np.int64)), pa.array(n[lo : lo + HELD])
                none = [pa.nulls(len(own[0]), k) for k in (kind, pa.int64(), pa.string(), pa.bool_(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*none, *own], names)

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            training = np.array([is_training(x) for x in batch.column(0).to_pylist()], bool)
            ids = coder.encode_all(batch.column(1))
            none = [pa.nulls(batch.num_rows, pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.arange(row, row + batch.num_rows)), batch.column(1).cast(pa.string()), pa.array(training), pa.array(ids, pa.binary()), *none], names)
            row += batch.num_rows
            for _, texts in wordhash.parts(batch.column(1).filter(pa.array(training))):
                held.append(np.unique(wordhash.words(texts).h, return_counts=True))
            held.append((np.array([_END_WORD], np.int64).view(np.uint64), np.array([training.sum()])))
            if sum(len(x) for x, _ in held) > HELD:
                held = [merged(held)]
                if len(held[0][0]) > HELD // 2:
                    yield from told(kind, held)
                    held = []
        if held:
            yield from told(kind, held)

    return run


def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the same words added; words that do not occur left out."""
    words, of = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
    n = np.bincount(of, np.concatenate([n for _, n in held]), len(words)).astype(np.int64)
    return words[n > 0], n[n > 0]


@trimmed
def _count_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(IDS, np.int64)
    for batch in batches:
        n += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u2"), minlength=IDS)
        n[END] += batch.num_rows
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["id", "n"])


def _averaged(shapes: dict, weights: list[dict]) -> tuple[dict, int]:
    """Mean weights by the number of windows, and that number."""
    total, n = {k: np.zeros(x, np.float64) for k, x in shapes.items()}, 0
    for r in weights:
        n += r["n"]
        for k, x in shapes.items():
            total[k] += r["n"] * np.frombuffer(r[f"w_{k}"], "<f4").reshape(x)
    return {k: x / max(1, n) for k, x in total.items()}, n


def fit_model(texts: DataFrame, rounds: int = ROUNDS) -> tuple[dict, dict]:
    """(weights, tables) from all ids of the training texts (ids binary): rounds of local training, averaged."""
    with small_batches(texts.sparkSession):
        got = texts.select("ids").mapInArrow(_count_ids, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # one row per id at most
    counts = np.zeros(IDS)
    counts[np.array(got["id"], np.int64)] = np.array(got["n"], np.float64)
    t = tables(counts)
    w = start(t["prior"])
    shapes, names = {k: x.shape for k, x in w.items()}, ["n", *(f"w_{k}" for k in w)]
    # Names of columns differ in more than case.
    names = [x + "_of_groups" if x in ("w_U", "w_C") else x for x in names]
    fields = "n long, " + ", ".join(f"{x} binary" for x in names[1:])
    row = lambda w, n: [pa.array([n], pa.int64()), *(pa.array([x.astype("<f4").tobytes()], pa.binary()) for x in w.values())]
    back = lambda r: {"n": r["n"]} | {f"w_{k}": r[x] for k, x in zip(shapes, names[1:], strict=True)}
    for k in range(rounds):
        shared = texts.sparkSession.sparkContext.broadcast((w, t))

        @trimmed
        def run(batches: Iterator[pa.RecordBatch], shared=shared, k=k) -> Iterator[pa.RecordBatch]:
            w, t = shared.value
            w, n = {x: y.copy() for x, y in w.items()}, 0
            seen = unseen(w)
            for batch in batches:  # a batch is bounded, so is what is held
                if windows := [windows_of(np.frombuffer(x, "<u2")) for x in batch.column(0).to_pylist()]:
                    windows = np.concatenate(windows)
                    train_here(w, t, windows, seen, k)
                    n += len(windows)
            if n:
                task = pa.array([TaskContext.get().partitionId() % TRAINERS], pa.int32())
                yield pa.RecordBatch.from_arrays([task, *row(w, n)], ["task", *names])

        @trimmed
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for listed in batch.column(0).to_pylist():
                    mean, n = _averaged(shapes, [back(r) for r in listed])
                    yield pa.RecordBatch.from_arrays(row(mean, n), names)

        trained = texts.select("ids").mapInArrow(run, "task int, " + fields).groupBy("task").agg(F.collect_list(F.struct(*names)).alias("listed")).select("listed").mapInArrow(add, fields)
        with small_batches(texts.sparkSession):
            rows = trained.collect()
        if rows:
            w = {x: y.astype(np.float32) for x, y in _averaged(shapes, [back(r) for r in rows])[0].items()}
    return w, t


def score_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, vocabulary of every document."""
    path, spark = path or tokenizer_path(), docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", whole_text().alias("text"))
    coded = stage(texts.mapInArrow(_encode(path), f"doc_id {kind}, row long, text string, training boolean, ids binary, word long, n long"), "lm-coded")
    texts = coded.where("row IS NOT NULL").select("doc_id", "row", "text", "training", "ids")
    counts = stage(coded.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("c")), "lm-counts")
    model = fit_model(texts.where("training"))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    by_size = sorted(counts.groupBy(F.floor(F.log2("c") * 8).cast("int").alias("level")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least")).collect(), reverse=True)  # a row per eighth of a power of 2
    held, bound = 0, 1 << 62
    for _, n, least in by_size:
        if (held := held + n) > HEAVY:
            break
        bound = least
    heavy = counts.where((F.col("c") >= bound) | (F.col("word") == _END_WORD)).toArrow().sort_by("c")
    ends = [c for c, w in zip(heavy["c"].to_pylist(), heavy["word"].to_pylist(), strict=True) if w == _END_WORD]
    known_words, slots = np.array(heavy["word"], np.int64), np.zeros(1 << SLOT_BITS, np.int32)
    slots[known_words.view(np.uint64) >> np.uint64(64 - SLOT_BITS)] = np.arange(len(known_words))
    shared = spark.sparkContext.broadcast((model, slots, known_words, np.log10(np.array(heavy["c"], np.float64) + 1), ends[0] if ends else 0))

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (w, t), slots, words, logs, ends = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                n_tokens, known, sums, rare, n_rare = [], [], [], [], []
                for _, part in wordhash.parts(batch.column(2)):
                    own = wordhash.words(part)
                    h = own.h.view(np.int64)
                    at = slots[own.h >> np.uint64(64 - SLOT_BITS)]
                    found = words[at] == h if len(words) else np.zeros(len(h), bool)
                    size = np.diff(own.first)
                    n_tokens.append(size + 1)
                    known.append(np.bincount(own.text, found, len(size)).astype(np.int64) + (ends > 0))
                    sums.append(np.bincount(own.text[found], logs[at[found]], len(size)) + np.log10(ends + 1))
                    rare.append(h[~found])
                    n_rare.append(np.bincount(own.text, ~found, len(size)))
                score = score_all(w, t, [np.frombuffer(x, "<u2") for x in batch.column(4).to_pylist()])
                held_out = pa.array([not x for x in batch.column(3).to_pylist()], pa.bool_())
                flat = lambda x, kind: pa.array(np.concatenate(x), kind)
                offsets = np.concatenate([[0], np.cumsum(np.concatenate(n_rare))]).astype(np.int32)
                values = [held_out, flat(n_tokens, pa.int64()), flat(known, pa.int64()), flat(sums, pa.float64()), pa.ListArray.from_arrays(pa.array(offsets), flat(rare, pa.int64())), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *values], ["doc_id", "row", "held_out", "n_tokens", "known", "logs", "rare", "score"])

    scored = stage(texts.mapInArrow(run, f"doc_id {kind}, row long, held_out boolean, n_tokens long, known long, logs double, rare array<bigint>, score double"), "lm-scored")
    rare = scored.select("row", F.explode("rare").alias("word")).join(counts, "word")
    rare = rare.groupBy("row").agg(F.count(F.lit(1)).alias("more"), F.sum(F.log10(F.col("c") + 1)).alias("more_logs"))
    full = scored.drop("rare").join(rare, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return full.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + zero("more")).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("logs") + zero("more_logs") - F.col("n_tokens") * float(np.log10(total + distinct + 1))).alias("base_score"), "score", F.lit(int(distinct)).cast("long").alias("vocabulary"),
    )


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))
