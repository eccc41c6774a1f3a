"""License scan, quality rules, media, packing and language model against plain Python."""

import gc
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from specweave.llm import common, license_scan, lm_scoring, media, packing, quality_classifier, quality_rules, subwords
from specweave.llm.common import stage
from specweave.llm.subwords import Subwords, tokenizer_path

EDGE = [(1, None), (2, ""), (3, " \n "), (4, "one"), (None, "a null id"), (5, "same row"), (5, "same row"), (6, "é\x00 b\x1cc\r\nd")]


def test_license_places_and_labels(make):
    rows = [*EDGE, (10, "All rights reserved. CC-BY all RIGHTS, reserved"), (11, "Licensed under the Apache License, Version 2.0."), (12, "licensed under the brand Apache License Version 2.0"), (13, "cc BY " * 500), (14, "GNU General Public License, version 3")]
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(make(rows).withColumn("score", F.lit("clash"))).collect()}
    assert (got[10]["n_base"], got[10]["first_word"], got[10]["last_word"], got[10]["base_labels"]) == (3, 0, 5, "cc-by,reserved")
    assert "apache-2.0" in got[11]["labels"] and got[11]["base_labels"] == "" and got[11]["score"] == 1.0
    assert "apache-2.0" in got[12]["labels"] and got[12]["score"] < 1
    assert got[13]["n_base"] == 500 and got[13]["last_word"] == 998
    assert got[14]["base_labels"] == "gpl"
    more = [(i, t) for i, t in enumerate(["Licensed under the GNU General Public License, version 3", "licensed under the gnu general public license version 2; x. Released under the MIT License", "licensed under CC BY-NC 4.0", "licensed under CC BY 4.0", "Licensed under CC BY-SA 4.0 and all rights reserved"])]
    labels = {r["doc_id"]: r["labels"] for r in license_scan.scan_licenses(make(more)).collect()}
    assert labels == {0: "gpl,gpl-3.0", 1: "gpl,gpl-2.0,mit", 2: "cc-by,cc-by-nc-4.0", 3: "cc-by,cc-by-4.0", 4: "cc-by,cc-by-sa-4.0,reserved"}
    assert (got[2]["n_words"], got[2]["first_word"], got[2]["labels"], got[2]["score"]) == (0, None, "", 0.0)
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, text in rows:
        assert got[i]["n_words"] == len(words.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))


def test_license_scan_of_nothing(make):
    assert license_scan.scan_licenses(make([(1, "x")]).where("false")).count() == 0


def test_rule_counts_match_plain_python(make):
    rng = random.Random(1)
    rows = [*EDGE, *((100 + i, "\n".join(" ".join(rng.choice(["a", "b", "c#", "dd|", "é$"]) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 9)))) for i in range(40))]
    model = quality_rules.start_weights()
    for r in quality_rules.apply_rules(make(rows), model).collect():
        text = r["text"] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        seen, again = set(), 0
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                again += line in seen
                seen.add(line)
        triples = Counter(zip(words, words[1:], words[2:], strict=False))
        inside = {i + k for i, t in enumerate(zip(words, words[1:], words[2:], strict=False)) if triples[t] > 1 for k in range(3)}
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(inside)), text
        assert r["base_failed"] == (len(words) < 50 or 100 * len(inside) > 50 * len(words))


def test_viterbi_matches_all_labellings():
    rng = random.Random(2)
    for _ in range(50):
        n = rng.randint(1, 7)
        scores, t = [[rng.gauss(0, 1), rng.gauss(0, 1)] for _ in range(n)], [[rng.gauss(0, 1) for _ in range(2)] for _ in range(2)]
        value = lambda m: sum(scores[i][x] for i, x in enumerate(m)) + sum(t[a][b] for a, b in zip(m, m[1:], strict=False))  # noqa: E731, B023
        best = max(([b >> i & 1 for i in range(n)] for b in range(1 << n)), key=value)
        assert value(quality_rules.viterbi(scores, t)) == pytest.approx(value(best))
    assert quality_rules.viterbi([], t) == []


def test_field_learns_lines():
    rng = np.random.default_rng(0)
    x = [np.c_[np.ones(5), rng.normal(k, 0.3, (5, 1)), np.zeros((5, quality_rules.N_FEATURES - 2))] for k in (0, 2) * 30]
    w, t = quality_rules.fit(x, [np.full(5, k) for k in (0, 1)] * 30)
    assert all(set(quality_rules.viterbi((s @ w).tolist(), t.tolist())) == {i % 2} for i, s in enumerate(x))


def test_field_is_fitted_on_all_lines(spark, make, monkeypatch):
    rows = [(i, "\n".join(f"line {k} of {i}" for k in range(n))) for i, n in enumerate((1, 63, 64, 65, 128, 300))]
    seen = []
    monkeypatch.setattr(quality_rules, "fit", lambda sequences, states: seen.extend(zip(map(len, sequences), states, strict=True)))
    quality_rules.train(make(rows), spark.createDataFrame([(i, i % 2, 0) for i in range(6)], "doc_id long, quality int, toxic int"))
    assert sorted(n for n, s in seen) == sorted([1, 63, 64, 64, 1, 64, 64, *[64] * 4, 44]) and all(len(s) == n <= quality_rules.FIT_LINES for n, s in seen)
    assert sum(s.sum() for _, s in seen) == 63 + 65 + 300


def test_lines_of_one_document_get_different_labels(spark, make):
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    prose = lambda: " ".join(word() for _ in range(20)) + "."
    menu = lambda: " | ".join(f"{word()} #" for _ in range(6))
    rows = [(i, "\n".join(prose() for _ in range(8))) for i in range(60)] + [(100 + i, "\n".join(menu() for _ in range(8))) for i in range(60)]
    rows += [(200 + i, "\n".join([menu(), menu(), *(prose() for _ in range(6)), menu(), menu()])) for i in range(60)]
    labels = spark.createDataFrame([(i, int(i < 100 or i >= 200), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    docs = make(rows).withColumn("n_lines", F.lit("clash"))
    got = {r["doc_id"]: r for r in quality_rules.apply_rules(docs, quality_rules.train(docs, labels)).collect()}
    assert all(got[i]["content_lines"] == 8 and got[i]["kept"] and got[100 + i]["content_lines"] == 0 and not got[100 + i]["kept"] for i in range(60))
    assert all(got[200 + i]["content_lines"] == 6 and got[200 + i]["n_lines"] == 10 and got[200 + i]["kept"] for i in range(60))


def test_media_round_trip(make):
    rng = random.Random(3)
    long = "".join(rng.choice("abc de\n") for _ in range(40_000))
    rows = [*EDGE, (20, long), (21, long), (22, long[:20_000] + "!" + long[20_000:]), (23, "x" * 64), (24, "é" * 33)]
    store = media.store_media(make(rows))
    got = media.read_media(*store).collect()
    assert len(got) == len(rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, t or "")
    for r in got:
        raw = texts[r["doc_id"]].encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["media_sha256"] == hashlib.sha256(media.to_media(payload)).hexdigest()
    stored = store[1].select(F.sum(F.length("bytes"))).first()[0]
    assert stored < 2 * len(long)  # three near-equal texts keep their common chunks once


def test_chunks_join_to_the_payload_and_survive_an_insertion():
    data = random.Random(4).randbytes(200_000)
    cut = media.chunks(data)
    assert b"".join(cut) == data and max(map(len, cut)) <= media.MOST
    other = set(media.chunks(data[:1000] + b"zz" + data[1000:]))
    assert len(other & set(cut)) > 0.9 * len(cut)


def test_ids_are_those_of_the_tokenizer_file():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    s = Subwords(tokenizer_path())
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "Zeta", " ", "  ", "\n", "\t", "'s", "é", "漢", "12", ".", "<|endoftext|>", "\x1c", " "]) for _ in range(rng.randint(0, 30))) for _ in range(600)]
    for text in [*texts, *texts]:
        assert s.encode(text) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


@pytest.mark.parametrize("bits", [3, subwords.PLACE_BITS])  # with few places pieces take each other's
def test_ids_of_whole_columns_are_those_of_the_tokenizer_file(bits, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(subwords, "PLACE_BITS", bits)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    s = Subwords(tokenizer_path())
    rng = random.Random(8)
    some = ["a", "A", "Zeta", " ", "\n", "'s", "é", "漢", "12", ".", "漢字é" * 9, "x", "<|endoftext|>", "\t", "\x1c", "\u00a0", "  "]
    # In the first half no text has other white space than single spaces and line ends, mostly.
    texts = ["".join(rng.choice(some[: 12 if i < 400 else None]) for _ in range(rng.randint(0, 12))) for i in range(800)]
    texts += ["", "end ", "end\n", "tab\t", "\tx y", "a" * 70_000, "A" * 70_000]
    for lo in [*range(0, len(texts), 90), 0]:
        ids = s.encode_all(pa.array(["left out", *texts[lo : lo + 90]]).slice(1))
        want = [np.array(t.encode(x, add_special_tokens=False).ids, "<u2").tobytes() for x in texts[lo : lo + 90]]
        assert ids == want
    assert s.encode_all(pa.array([], pa.string())) == []


def test_new_pieces_are_encoded_together():
    s, calls = Subwords(tokenizer_path()), []
    ids = s._ids
    s._ids = lambda text: calls.append(text) or ids(text)
    texts = pa.array([" ".join(f"w{i * j}" for i in range(1, 60)).strip() for j in range(1, 40)])
    once, n = s.encode_all(texts), len(calls)
    assert n == 1 and s.encode_all(texts) == once and len(calls) <= 2  # pieces that lost their place come again


def test_first_fit_decreasing_is_the_plain_one():
    rng = random.Random(6)
    for _ in range(60):
        sizes = [rng.randint(1, 100) for _ in range(rng.randint(1, 60))]
        bins, offsets = packing.first_fit_decreasing(sizes, 100)
        room, want = [], {}
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            b = next((b for b, r in enumerate(room) if r >= sizes[i]), None)
            if b is None:
                b = len(room)
                room.append(100)
            want[i] = (b, 100 - room[b])
            room[b] -= sizes[i]
        assert {i: x for i, x in enumerate(zip(bins, offsets, strict=True))} == want


def test_packing_is_whole_and_gapless(make):
    rows = [*EDGE, *((100 + i, "word " * n) for i, n in enumerate((1, 10, 2046, 2047, 2048, 5000, 300, 700)))]
    got = packing.pack(make(rows), group=8).toPandas()
    assert set(got["doc_id"].dropna()) == {i for i, _ in rows if i is not None} and got["length"].max() <= 2048
    assert (got.groupby("row")["length"].sum() == got.groupby("row")["doc_tokens"].first()).all()
    x = got.sort_values(["sequence_id", "offset"])
    assert (x.groupby("sequence_id")["length"].cumsum() - x["length"] == x["offset"]).all()
    s = Subwords(tokenizer_path())
    (r,) = got[got["doc_id"] == 100].itertuples()
    ids = s.encode("word ") + (1).to_bytes(4, "little")
    assert (r.ids_crc32, r.doc_tokens) == (zlib.crc32(ids), len(ids) // 4)
    assert packing.pack(make(rows).where("false")).count() == 0


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    t = lm_scoring.tables(rng.integers(0, 50, lm_scoring.IDS).astype(float))
    w = {k: x.astype(np.float64) for k, x in lm_scoring.start(t["prior"]).items()}
    w |= {k: rng.normal(0, 0.5, w[k].shape) for k in ("u", "U")}
    b, y = rng.integers(0, lm_scoring.BUCKETS, (3, lm_scoring.LENGTH)), rng.integers(0, lm_scoring.CLASSES, (3, lm_scoring.LENGTH)).astype(np.uint8)
    there = rng.random(b.shape) < 0.8
    loss = lambda w: -(lm_scoring.log_probabilities(w, w["e"][b] + w["p"], y) * there).sum() / there.sum()
    g = lm_scoring.gradients(w, b, y, there)
    own, values = g["e"]
    g["e"] = np.zeros_like(w["e"])
    g["e"][own] = values
    assert set(g) == set(w)
    for k in w:
        i = (int(b[0, 3]), 2) if k == "e" else tuple(int(rng.integers(0, n)) for n in w[k].shape)
        up, down = ({a: x.copy() for a, x in w.items()} for _ in range(2))
        up[k][i] += 1e-5
        down[k][i] -= 1e-5
        assert g[k][i] == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=1e-6)


def test_windows_score_each_id_once():
    t = lm_scoring.tables(np.ones(lm_scoring.IDS))
    w = lm_scoring.start(t["prior"])  # class scores do not depend on context yet
    for n in (0, 1, 5, 31, 32, 33, 100, 257):
        ids = np.arange(n)
        want = sum(t["prior"][t["class"][i]] + t["share"][i] for i in [*range(n), lm_scoring.END]) / math.log(10)
        assert lm_scoring.score_all(w, t, [ids])[0] == pytest.approx(want, rel=1e-4)


def test_only_places_that_count_are_scored(monkeypatch):
    t = lm_scoring.tables(np.ones(lm_scoring.IDS))
    w, n, plain = lm_scoring.start(t["prior"]), [], lm_scoring.log_probabilities
    monkeypatch.setattr(lm_scoring, "log_probabilities", lambda w, x, target: n.append(target.size) or plain(w, x, target))
    lm_scoring.score_all(w, t, [np.arange(lm_scoring.LENGTH + 9 * (lm_scoring.LENGTH - lm_scoring.OVERLAP) - 1)])
    assert sum(n) == lm_scoring.LENGTH + 9 * (lm_scoring.LENGTH - lm_scoring.OVERLAP)  # the end too


def test_scores_of_some_places_are_those_of_all():
    rng, t = np.random.default_rng(4), lm_scoring.tables(np.ones(lm_scoring.IDS))
    w = {k: x + rng.normal(0, 0.5, x.shape).astype(np.float32) for k, x in lm_scoring.start(t["prior"]).items()}
    w["q"] *= 40  # some scores are held to the most
    x, target = rng.normal(size=(5, lm_scoring.LENGTH, lm_scoring.WIDTH)).astype(np.float32), rng.integers(0, lm_scoring.CLASSES, (5, lm_scoring.LENGTH)).astype(np.uint8)
    got = lm_scoring.log_probabilities(w, x, target)
    assert np.isfinite(got).all() and np.allclose(lm_scoring.log_probabilities(w, x, target[:, 6:]), got[:, 6:], atol=1e-4)


def test_every_id_of_the_training_texts_is_learnt_from(make):
    rng = random.Random(9)
    rows = [*EDGE, *((200 + i, " ".join(rng.choice(["alpha", "Beta", f"rare{i}"]) for _ in range(n))) for i, n in enumerate((31, 32, 33, 700, 5000)))]
    s, want = Subwords(tokenizer_path()), Counter()
    for i, t in rows:
        if lm_scoring.is_training(i):
            want.update([*np.frombuffer(s.encode(t or ""), "<u4").tolist(), lm_scoring.END])
    coded = make(rows).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(lm_scoring._encode(tokenizer_path()), "doc_id long, row long, text string, training boolean, ids binary, word long, n long").cache()
    assert coded.where("row IS NOT NULL").count() == len(rows) == coded.select("row").distinct().where("row IS NOT NULL").count()
    ids = coded.where("training").select("ids").mapInArrow(lm_scoring._count_ids, "id int, n long")
    assert {r["id"]: r["n"] for r in ids.groupBy("id").agg(F.sum("n").alias("n")).collect()} == want
    for n in (0, 1, 31, 32, 33, 64, 100):
        w = lm_scoring.windows_of(np.arange(n))
        following = w[:, 1:].ravel()
        assert following[following >= 0].tolist() == [*range(n), lm_scoring.END] and w[1:, 0].tolist() == w[:-1, -1].tolist()


def test_base_scores_and_learning(make):
    rng = random.Random(7)
    rows = [*EDGE, *((100 + i, " ".join(rng.choice(["alpha", "Beta", "gamma", "delta", f"rare{i}"]) for _ in range(60))) for i in range(60))]
    got = lm_scoring.score_documents(make(rows)).collect()
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "\n"]
    training = [t for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    c = Counter(x for t in training for x in tokens(t))
    n, v = sum(c.values()), len(c)
    texts = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        own = tokens(texts[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(x in c for x in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in own))
        assert r["score"] < 0
    # Trained, the model holds texts of the same words more likely than its classes alone do.
    held = [r["score"] for r in got if r["held_out"] and r["doc_id"] and 100 <= r["doc_id"] < 200]
    assert held and lm_scoring.score_documents(make(rows).where("false")).count() == 0


def test_training_raises_the_likelihood_of_held_out_texts():
    rng = np.random.default_rng(3)
    follows = rng.permutation(300)  # each id has one likely follower

    def text(n):
        out = [int(rng.integers(300))]
        while len(out) < n:
            out.append(int(follows[out[-1]]) if rng.random() < 0.8 else int(rng.integers(300)))
        return np.array(out, "<u2")

    texts = [text(400) for _ in range(250)]
    counts = np.bincount(np.concatenate(texts[:200]), minlength=lm_scoring.IDS).astype(float)
    t = lm_scoring.tables(counts)
    w = lm_scoring.start(t["prior"])
    before, seen = sum(lm_scoring.score_all(w, t, texts[200:])), lm_scoring.unseen(w)
    for lo in range(0, 200, 20):
        lm_scoring.train_here(w, t, np.concatenate([lm_scoring.windows_of(x) for x in texts[lo : lo + 20]]), seen)
    after = sum(lm_scoring.score_all(w, t, texts[200:]))
    assert after > before + 0.02 * abs(before)


def test_classifier_learns_grades_and_orders_them(spark, make):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    rows, labels = [*EDGE], []
    for i in range(300):
        kind = i % 3
        base = [word() for _ in range(60)]
        text = " ".join(base + ["awful", "nasty"]) if kind == 0 else "### ".join(base[:20]) if kind == 1 else " ".join(base)
        rows.append((1000 + i, text))
        labels.append((1000 + i, int(kind != 1), int(kind == 0)))
    table = spark.createDataFrame([*labels, (None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    docs = make(rows)
    model = quality_classifier.train(docs, table.where("doc_id % 5 <> 0 OR doc_id IS NULL"))
    assert model[2][0] <= model[2][1]
    got = {r["doc_id"]: r for r in quality_classifier.classify(docs, model).collect()}
    held = [(i, q, t) for i, q, t in labels if i % 5 == 0]
    right = [got[i]["kept"] == (q == 1 and t == 0) for i, q, t in held]
    assert sum(right) > 0.9 * len(right)
    assert all(0 <= r["tail_probability"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in got.values())
    empty = quality_classifier.train(docs, table.where("false"))
    assert quality_classifier.classify(docs, empty).where("NOT kept").count() == 0


def test_stage_is_written(spark):
    assert stage(spark.range(5), "t").count() == 5


def test_memory_is_given_back_without_searching_the_modules_again():
    common.give_back()
    assert gc.get_freeze_count() > 10_000  # what is frozen is not searched
    frozen = gc.get_freeze_count()
    common.give_back()
    assert gc.get_freeze_count() <= frozen
