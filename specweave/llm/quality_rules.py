"""Quality rules: a linear-chain conditional random field marks each line as content or boilerplate.

Line features feed a two-state chain whose weights are trained by gradient ascent on the conditional
likelihood, on a bounded sample of labelled documents (MAX_LABELLED). There are no labels of lines, so each line of
the sample gets a weak one of its own: its document's rating, unless the line itself speaks against it. In a good
document a line that repeats an earlier one or is full of symbols is boilerplate; in a poor one a long line that
ends like a sentence, is new and has few symbols is content. So sequences hold both states and changes between them
are learnt. Viterbi decoding labels the lines of every whole
text; the share of words in content lines decides whether a document is kept, after fixed base rules.

Defined cases: a null or empty text has no words, content share 0 and fails the base rules; lines without a
word are skipped; repeated rows are treated each; without usable labels the start weights mark all lines as
content; input columns named as an output column are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from specweave.llm.common import append, documents, labelled_sample

#: Labelled rows in the fit, at most, and lines of one training sequence; longer texts give several.
MAX_LABELLED, FIT_LINES = 4_000, 64
#: Content share from which a document is kept.
LEAST_CONTENT = 0.5
#: Base rules: fewest words, and most percent of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
WINDOW = 3
#: Symbols a word from which a line is full of them, or no longer has few; words of a line that reads like a sentence.
MANY_SYMBOLS, FEW_SYMBOLS, SENTENCE = 0.25, 0.1, 16
_SYMBOLS, _DIGITS = b"#*$%&|<>", b"0123456789"
N_FEATURES = 10


def line_features(line: bytes, words: list[bytes], again: bool) -> list[float]:
    n, size = len(words), len(line)
    return [
        1.0, math.log1p(n) / 5, min(1.0, (size - len(line.translate(None, _SYMBOLS))) / n), (size - len(line.translate(None, _DIGITS))) / size, float(again),
        len(set(words)) / n, float(line.rstrip()[-1:] in (b".", b"!", b"?")), min(2.0, line.count(b"|") / n), min(2.0, size / n / 10), sum(map(bytes.__eq__, words, words[1:])) / n,
    ]


def scan(text: str) -> tuple[list[int], list[list[float]], list[int]]:
    """([n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words], line features, words of those lines)."""
    raw = text.encode("utf-8", "replace")
    seen: set[bytes] = set()
    words, rows, sizes, again = [], [], [], 0
    for line in raw.split(b"\n"):
        if own := line.split():
            known = line in seen
            again += known
            seen.add(line)
            rows.append(line_features(line, own, known))
            sizes.append(len(own))
            words += own
    n = len(words)
    repeated = 0
    if n >= WINDOW:
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
        key = ids[: n - WINDOW + 1].copy()
        for k in range(1, WINDOW):
            key = np.unique(key * len(number) + ids[k : n - WINDOW + 1 + k], return_inverse=True)[1] if k + 1 < WINDOW else key * len(number) + ids[k : n - WINDOW + 1 + k]
        _, where, count = np.unique(key, return_inverse=True, return_counts=True)
        twice = count[where] > 1
        inside = np.zeros(n, bool)
        for k in range(WINDOW):
            inside[k : n - WINDOW + 1 + k] |= twice
        repeated = int(inside.sum())
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    return [n, chars, len(raw) - len(raw.translate(None, _SYMBOLS)), again, repeated], rows, sizes


def start_weights() -> tuple[np.ndarray, np.ndarray]:
    """(feature weights by state, transition weights); states are boilerplate and content."""
    w = np.zeros((N_FEATURES, 2))
    w[0, 1] = 0.1
    return w, np.zeros((2, 2))


def fit(sequences: list[np.ndarray], states: list[np.ndarray], epochs: int = 60, rate: float = 0.5, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Maximum conditional likelihood by full-batch gradient ascent; forward and backward over padded lines."""
    w, t = start_weights()
    pairs = [(x, y) for x, y in zip(sequences, states, strict=True) if len(x)]
    if not pairs:
        return w, t
    size, most = len(pairs), max(len(x) for x, _ in pairs)
    x, there, gold = np.zeros((size, most, N_FEATURES)), np.zeros((size, most), bool), np.zeros((size, most, 2))
    for i, (own, marks) in enumerate(pairs):
        x[i, : len(own)], there[i, : len(own)], gold[i, np.arange(len(own)), marks] = own, True, 1
    total = there.sum()
    pairs = there[:, 1:]
    gold_t = np.einsum("nta,ntb->ab", gold[:, :-1] * pairs[..., None], gold[:, 1:])
    gold_w = np.einsum("ntf,nts->fs", x, gold)
    seen_w, seen_t = np.full_like(w, 1e-8), np.full_like(t, 1e-8)
    for _ in range(epochs):
        e = x @ w
        a, b = np.zeros((size, most, 2)), np.zeros((size, most, 2))
        a[:, 0] = e[:, 0]
        for k in range(1, most):
            step = np.logaddexp(a[:, k - 1, 0, None] + t[0], a[:, k - 1, 1, None] + t[1]) + e[:, k]
            a[:, k] = np.where(there[:, k, None], step, a[:, k - 1])
        z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
        for k in range(most - 2, -1, -1):
            ahead = e[:, k + 1] + b[:, k + 1]
            b[:, k] = np.where(there[:, k + 1, None], np.logaddexp(t[:, 0] + ahead[:, 0, None], t[:, 1] + ahead[:, 1, None]), 0)
        p = np.exp(a + b - z[:, None, None]) * there[..., None]
        both = np.exp(a[:, :-1, :, None] + t + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]) * pairs[..., None, None]
        gw = (gold_w - np.einsum("ntf,nts->fs", x, p)) / total - decay * w
        gt = (gold_t - both.sum((0, 1))) / total - decay * t
        seen_w, seen_t = seen_w + gw**2, seen_t + gt**2
        w, t = w + rate * gw / np.sqrt(seen_w), t + rate * gt / np.sqrt(seen_t)
    return w, t


def viterbi(scores: list[list[float]], t: list[list[float]]) -> list[int]:
    """The best states of the lines; ties go to content."""
    if not scores:
        return []
    (a, b), back = scores[0], []
    for x, y in scores[1:]:
        from_a = b + t[1][0] < a + t[0][0]
        from_b = b + t[1][1] < a + t[0][1]
        back.append((0 if from_a else 1, 0 if from_b else 1))
        a, b = (a + t[0][0] if from_a else b + t[1][0]) + x, (a + t[0][1] if from_b else b + t[1][1]) + y
    out = [int(b >= a)]
    for step in reversed(back):
        out.append(step[out[-1]])
    return out[::-1]


def line_states(x: np.ndarray, sizes: np.ndarray, good: bool) -> np.ndarray:
    """The weak state of each line of a document by its features and words: 1 content, 0 boilerplate."""
    new = x[:, 4] == 0
    return (new & (x[:, 2] < MANY_SYMBOLS) if good else new & (x[:, 2] < FEW_SYMBOLS) & (x[:, 6] > 0) & (sizes >= SENTENCE)).astype(int)


def _observed(text: str) -> tuple[bytes, bytes]:
    """Features and words of a text's lines."""
    _, rows, sizes = scan(text)
    return np.array(rows, np.float64).tobytes(), np.array(sizes, np.int32).tobytes()


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Weights from a bounded sample of labelled documents, all of their lines."""
    sample = append(labelled_sample(docs, labels, most), "f binary, n binary", lambda: lambda texts: list(zip(*map(_observed, texts), strict=True)) or [[]] * 2, keep=False)
    got = sample.toArrow().sort_by([("doc_id", "ascending"), ("f", "ascending")])
    texts = [np.frombuffer(x).reshape(-1, N_FEATURES) for x in got["f"].to_pylist()]
    states = [line_states(x, np.frombuffer(n, np.int32), q > 0) for x, n, q in zip(texts, got["n"].to_pylist(), got["quality"].to_pylist(), strict=True)]
    cut = [(x[i : i + FIT_LINES], s[i : i + FIT_LINES]) for x, s in zip(texts, states, strict=True) for i in range(0, len(x), FIT_LINES)]
    return fit([x for x, _ in cut], [s for _, s in cut])


def apply_rules(docs: DataFrame, model) -> DataFrame:
    """docs with the base counts, n_lines, content_lines, content_share, base_failed and kept."""
    w, t = (np.asarray(m) for m in model)
    moves = t.tolist()

    def compute():
        def one(text):
            (n, chars, symbols, again, repeated), rows, sizes = scan(text)
            marks = viterbi((np.array(rows).reshape(-1, N_FEATURES) @ w).tolist(), moves)
            share = sum(s for s, m in zip(sizes, marks, strict=True) if m) / max(1, n)
            failed = n < LEAST_WORDS or 100 * repeated > MOST_REPEATED * n
            return n, chars, symbols, again, repeated, len(rows), sum(marks), share, failed, not failed and share >= LEAST_CONTENT

        return lambda texts: list(zip(*map(one, texts), strict=True)) or [[]] * 10

    counts = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, content_lines long"
    return append(docs, f"{counts}, content_share double, base_failed boolean, kept boolean", compute)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return apply_rules(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).drop("text")
