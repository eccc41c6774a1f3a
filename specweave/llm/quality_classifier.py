"""Quality classifier: cumulative-link regression on graded ratings over hashed words and word beginnings.

A document's grade is 0 (toxic), 1 (poor) or 2 (good). One weight vector over hashed words and hashed text
statistics is shared by all grades and ordered thresholds cut its score s: P(grade <= k) = sigmoid(t_k - s).
That gives the expected grade and the tail probability P(grade >= 2), by which documents are selected.

The model is fitted on the driver on a bounded sample of labelled rows (MAX_LABELLED); every document is
scored whole.

Defined cases: a null or empty text has statistics only; labels without a rating or an id are ignored; with no
usable labels every document gets probability 0.5 for the tail and is kept; repeated rows are scored each;
input columns named as an output column are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from specweave.llm.common import append, documents, give_back, labelled_sample

#: Labelled rows in the fit, at most.
MAX_LABELLED = 12_000
#: Hash buckets.
BUCKETS = 1 << 20
#: A word takes part if so many documents of the sample have it.
LEAST_DOCUMENTS = 8
#: Beginnings of longer words, in bytes, that count as words too.
BEGINNINGS = (6, 7, 8)
#: Documents are kept from this tail probability.
KEEP = 0.5
GRADES = 3
_PUNCTUATION = bytes(32 if chr(i) in ".,;:!?\"'()[]{}" else i for i in range(256))
_SYMBOLS = b"#*$%&|<>"


def features(text: str) -> np.ndarray:
    """The distinct hash buckets of a text's words and statistics."""
    raw = text.encode("utf-8", "replace").lower()
    words = raw.translate(_PUNCTUATION).split()
    n, kinds = len(words), set(words)
    lines = [x for x in raw.split(b"\n") if x]
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    bins = {
        b"n": min(12, n.bit_length()),
        b"symbols": int(20 * min(1.0, symbols / max(1, n))),
        b"bars": int(20 * min(1.0, raw.count(b"|") / max(1, n))),
        b"kinds": int(20 * len(kinds) / max(1, n)) * 16 + min(12, n.bit_length()),
        b"lines": int(10 * len(set(lines)) / max(1, len(lines))),
        b"adjacent": int(20 * sum(map(bytes.__eq__, words, words[1:])) / max(1, n)),
    }
    begin = {b"\1" + w[:k] for k in BEGINNINGS for w in kinds if len(w) > k}
    kinds.update(b"\0%s:%d" % x for x in bins.items())
    kinds |= begin
    return np.unique(np.fromiter(map(zlib.crc32, kinds), np.uint32, len(kinds)) & (BUCKETS - 1)).astype(np.int32)


def fit(rows: list[np.ndarray], grades: np.ndarray, epochs: int = 30, rate: float = 0.1, decay: float = 3e-3, batch: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket ids, their weights, thresholds) by Adagrad over minibatches in a fixed order."""
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.float32), np.array([-1.0, 0.0])
    ids, counts = np.unique(np.concatenate(rows), return_counts=True)
    ids = ids[counts >= LEAST_DOCUMENTS]
    rows = [np.flatnonzero(np.isin(ids, r, assume_unique=True)) if len(r) > len(ids) else (lambda p: p[(p < len(ids)) & (ids[np.minimum(p, len(ids) - 1)] == r)] if len(ids) else p)(np.searchsorted(ids, r)) for r in rows]
    share = np.array([max(1, (grades <= k).sum()) / len(grades) for k in range(GRADES - 1)]).clip(1e-3, 1 - 1e-3)
    cuts = np.log(share / (1 - share))
    w, seen, seen_cuts = np.zeros(len(ids)), np.full(len(ids), 1e-6), np.full(GRADES - 1, 1e-6)
    rng = np.random.default_rng(0)
    below = grades[:, None] <= np.arange(GRADES - 1)
    for _ in range(epochs):
        for chosen in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // batch)):
            flat = np.concatenate([rows[i] for i in chosen])
            of = np.repeat(np.arange(len(chosen)), [len(rows[i]) for i in chosen])
            s = np.bincount(of, w[flat], len(chosen))
            # One logistic loss per threshold; together they keep the thresholds ordered.
            g = 1 / (1 + np.exp(-(cuts - s[:, None]).clip(-30, 30))) - below[chosen]
            used = np.unique(flat)
            gw = np.bincount(flat, -g.sum(1)[of], len(ids))[used] + decay * len(chosen) * w[used]
            seen[used] += gw**2
            w[used] -= rate * gw / np.sqrt(seen[used])
            seen_cuts += g.sum(0) ** 2
            cuts = np.sort(cuts - rate * g.sum(0) / np.sqrt(seen_cuts))
    return ids.astype(np.int64), w.astype(np.float32), cuts


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED):
    """The fitted model from a bounded sample of labelled documents."""
    sample = append(labelled_sample(docs, labels, most), "f binary", lambda: lambda texts: [[features(x).tobytes() for x in texts]], keep=False)
    got = sample.toArrow().sort_by([("doc_id", "ascending"), ("f", "ascending")])
    toxic, quality = (np.array(got[c].to_pylist(), np.int64) for c in ("toxic", "quality"))
    model = fit([np.frombuffer(x, np.int32) for x in got["f"].to_pylist()], np.where(toxic > 0, 0, np.where(quality > 0, 2, 1)))
    del sample, got
    give_back()
    return model


def classify(docs: DataFrame, model) -> DataFrame:
    """docs with score, expected_grade, tail_probability and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most one weight per bucket

    def compute():
        ids, weights, cuts = shared.value
        dense = np.zeros(BUCKETS, np.float32)
        dense[ids] = weights

        def run(texts):
            s = np.array([float(dense[features(x)].sum(dtype=np.float64)) for x in texts])
            below = 1 / (1 + np.exp(-(cuts - s[:, None]).clip(-60, 60)))
            tail = 1 - below[:, -1]
            return [s, (1 - below).sum(1), tail, tail >= KEEP]

        return run

    return append(docs, "score double, expected_grade double, tail_probability double, kept boolean", compute)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return classify(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).drop("text")
