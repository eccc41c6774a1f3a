"""Line dedup, near-duplicates, passages, mixing and the pipeline against brute force."""

import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from specweave.llm import line_dedup, mix_sources, near_dedup, substring_dedup, wordhash
from specweave.llm.graph import components

RNG = random.Random(11)
VOCABULARY = ["".join(RNG.choice("abcdefghijkl") for _ in range(RNG.randint(2, 7))) for _ in range(800)]


def words(n, rng=RNG):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def edited(w, n, rng=RNG):
    w = list(w)
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(VOCABULARY) + "x"
    return w


EDGE = [(9001, None), (9002, ""), (9003, " \n"), (9004, "one"), (9005, "same row here"), (9005, "same row here"), (None, "a null id")]


def corpus():
    rows, base = [*EDGE], words(150)
    rows += [(i, " ".join(edited(base, RNG.randint(0, 9)))) for i in range(60)]  # a family
    rows += [(100 + i, " ".join(words(RNG.randint(1, 120)))) for i in range(60)]
    rows += [(200 + i, rows[i + 70][1]) for i in range(12)]  # exact copies
    for i in range(12):
        a = words(160)
        rows += [(300 + 2 * i, " ".join(a)), (301 + 2 * i, " ".join(edited(a, i)))]
    return rows


@pytest.fixture(scope="module")
def docs_rows():
    return corpus()


def test_near_classes_match_brute_force(make, docs_rows):
    got = near_dedup.near_duplicates(make(docs_rows, 4).withColumn("keep", F.lit("clash"))).collect()
    assert len(got) == len(docs_rows)
    ids = [i for i, t in docs_rows if t and t.split() and i is not None]
    text = {i: near_dedup.words_of(t) for i, t in docs_rows if i in ids}
    parent = {i: i for i in text}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in text:
        for b in text:
            if a < b and near_dedup.similarity(text[a], text[b]) >= near_dedup.SIMILARITY:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    cls = {r["doc_id"]: r["class_id"] for r in got}
    assert {i: cls[i] for i in text} == {i: root(i) for i in text}
    kept = Counter(r["class_id"] for r in got if r["keep"])
    assert set(kept.values()) == {1} and len(kept) == len({r["class_id"] for r in got})
    assert len({cls[i] for i in (9001, 9002, 9003)}) == 1


def test_links_are_named_as_the_checked_ones(make):
    rng = random.Random(19)
    base = words(150, rng)
    docs = make([(i, " ".join(edited(base, 1, rng))) for i in range(12)]).withColumn("n_links", F.lit("kept"))
    got = near_dedup.near_duplicates(docs).collect()
    assert {r["n_links"] for r in got} == {"kept"} and len({r["class_id"] for r in got}) == 1
    assert all(1 <= r["n_checked_links"] <= 11 for r in got)


def joined_rows(spark, run):
    """(rows that each join on shingle made while run() worked, its result)."""
    store, made = spark._jsparkSession.sharedState().statusStore(), []
    before = store.executionsCount()
    result = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    told = store.executionsList()
    for i in range(before, told.size()):
        key = told.apply(i).executionId()
        values, nodes = store.executionMetrics(key), store.planGraph(key).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            if "Join" in node.name() and "[shingle" in node.desc():
                metrics = [node.metrics().apply(k) for k in range(node.metrics().size())]
                made += [int(values.apply(m.accumulatorId()).replace(",", "")) for m in metrics if m.name() == "number of output rows" and values.contains(m.accumulatorId())]
    return made, result


def test_members_of_classes_meet_by_few_rows_and_lose_no_link(spark, monkeypatch):
    rng = random.Random(31)
    bases = [words(150, rng), words(150, rng)]
    own = words(8, rng)
    texts = [" ".join([*edited(bases[0], rng.randint(0, 3), rng), *own]) for _ in range(80)]
    texts += [" ".join(edited(bases[i % 2], rng.randint(0, 9), rng)) for i in range(30)]
    texts += [" ".join([*words(60, rng), *bases[0][:90]]) for _ in range(10)]  # share much, but are not similar
    label = [0] * 80 + [i for i in range(80, 120)]
    sets = [near_dedup.labelled_shingles(wordhash.words(pa.array([t]))[0]) for t in texts]
    rows = spark.createDataFrame([(i, len(sets[i]), label[i]) for i in range(120)], "row long, size int, label long")
    sources = spark.createDataFrame(list(enumerate(texts)), "_row long, text string")
    staged, real = {}, near_dedup.stage
    monkeypatch.setattr(near_dedup, "stage", lambda df, name, *more: staged.setdefault(name, real(df, name, *more)))
    made, got = joined_rows(spark, lambda: near_dedup._between_classes(rows, sources).collect())
    listed = [near_dedup.words_of(t) for t in texts]
    alike = {(a, b) for a in range(120) for b in range(a + 1, 120) if label[a] != label[b] and near_dedup.similarity(listed[a], listed[b]) >= near_dedup.SIMILARITY}
    assert len(alike) > 100 and alike <= {(r["a"], r["b"]) for r in got}
    assert all(r["a"] < r["b"] and label[r["a"]] != label[r["b"]] for r in got) and len(set(got)) == len(got)
    found = defaultdict(set)
    for r in staged["near-entries"].collect():
        found[r["shingle"]].add(r["label"])
    assert found and all(len(x) > 1 for x in found.values())  # what one class alone has meets nobody
    occurrences = Counter(x for s in sets for x in s.tolist())
    shared = sum(n for n in occurrences.values() if n > 1)
    n_prefixes = sum(len(s) - int(np.ceil(0.8 * len(s) - 1e-9)) + 1 for s in sets)
    assert made and max(made) <= n_prefixes < shared / 2


def test_alignment_is_the_longest_common_subsequence():
    rng = random.Random(12)
    for _ in range(60):
        a, b = ([rng.randrange(5) for _ in range(rng.randint(1, 25))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert near_dedup.aligned(a, b, 30) == t[-1][-1]


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(links).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 102: 100}
    assert components(links.where("false")).count() == 0


def test_removed_lines_match_brute_force(make):
    rng = random.Random(13)
    pool = [words(rng.randint(1, 14), rng) for _ in range(40)]
    line = lambda: " ".join(edited(p := rng.choice(pool), rng.randint(0, 2), rng) if rng.random() < 0.6 else rng.choice(pool) if rng.random() < 0.5 else words(9, rng))  # noqa: E731, F841
    rows = [(9001, None), (9002, ""), (9003, " \n"), *((i, "\n".join(line() for _ in range(rng.randint(1, 9)))) for i in range(60))]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(make(rows)).collect()}
    seen = []
    for i, t in sorted(rows):
        left = []
        for x in (t or "").split("\n"):
            s = frozenset(x.encode().lower().split())
            late = bool(s) and any(len(s & o) >= 0.8 * len(s | o) - 1e-9 for o in seen)
            if s:
                seen.append(s)
            if not late:
                left.append(x)
        assert (got[i]["text"] or "") == "\n".join(left), i
        if t is not None:
            assert got[i]["n_chars"] == len(got[i]["text"])
    assert line_dedup.dedup_lines(make(rows).where("false")).count() == 0


def indexed(sets, blocks=None, asked=None):
    """Index entries of sets of words, line k of document 0 each, and their words."""
    h = [np.sort(np.array([zlib.crc32(w.encode()) * 0x9E3779B97F4A7C15 % 2**64 for w in s], np.uint64)) for s in sets]
    size, flat = np.array([len(x) for x in h]), np.concatenate(h)
    at = np.cumsum(size) - size
    zero, line = np.zeros(len(sets), np.int64), np.arange(len(sets))
    levels = np.full(line_dedup.TABLE, 2, np.uint8)
    known = np.unique(line_dedup.prefixes(size, flat, levels)[1])[::2] if blocks else np.zeros(0, np.uint32)
    dealt = np.stack([known, np.full(len(known), blocks or 0, np.uint32)])
    rows, of = line_dedup.entries(size, flat, at, (zero, zero, line), line_dedup.digests(flat, at)[0], levels, dealt, asked=asked)
    return rows, np.concatenate([h[i] for i in of.tolist()])


@pytest.mark.parametrize("blocks", [None, 17])
def test_index_finds_every_line_that_has_an_earlier_match(blocks):
    rng = random.Random(21)
    pool = [words(rng.randint(5, 40), rng) for _ in range(12)]
    sets = list(dict.fromkeys(frozenset(edited(rng.choice(pool), rng.randint(0, 6), rng)) for _ in range(400)))
    want = {k for k, s in enumerate(sets) if any(len(s & o) >= 0.8 * len(s | o) - 1e-9 for o in sets[:k])}
    rows, flat = indexed(sets, blocks)
    assert blocks is None or rows["block"].max() > 10
    ordered, _, later, earlier, n = line_dedup.partners(rows)
    found = {int(x) for x in ordered["line"][later]}
    assert want <= found and (ordered["line"][earlier] < ordered["line"][later]).all() and (n >= 1).all()
    got = line_dedup.settled(rows, flat)
    assert {int(x) for x in got["line"]} == want
    size = rows["size"].astype(np.int64)
    *_, fewer, _, _ = line_dedup.partners(rows, wide=line_dedup.wide_parities(flat, size))
    assert want <= {int(x) for x in ordered["line"][fewer]} and len(fewer) <= len(later)
    some = np.array([k % 3 == 0 for k in range(len(sets))])
    rows, flat = indexed(sets, blocks, asked=some)
    assert {int(x) for x in line_dedup.settled(rows, flat)["line"]} == {k for k in want if k % 3 == 0}
    assert (line_dedup.unpacked(line_dedup.packed(rows), line_dedup.ENTRY) == rows).all()


def test_line_dedup_edges(make):
    long = "\n".join(f"line {i} of a very long text with {i * 7} and {i * 13} words" for i in range(30_000))
    rows = [(None, "one two three four five"), (1, long), (2, "one two three four five\n\n x"), (2, "one two three four five\n\n x"), (2, "one two three four five"), (3, None)]
    docs = make(rows).withColumns({"at": F.lit(1), "key": F.lit("k"), "late": F.lit(2.5), "_key": F.lit("u"), "n_removed": F.lit("clash")})
    got = line_dedup.dedup_lines(docs).collect()
    assert len(got) == 6 and all((r["at"], r["key"], r["late"], r["_key"]) == (1, "k", 2.5, "u") for r in got)
    by = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_lines"], r["n_removed"], r["text"] if r["doc_id"] != 1 else "") for r in got)
    # Of the rows with id 2 the pair of equal ones is one document; the order between it and the other is by hash.
    gone = [x[3] for x in by if x[1] == 2]
    assert sorted(gone) in ([0, 0, 1], [0, 1, 1]) and gone.count(1) in (1, 2)
    assert by[-1] == (True, 0, 1, 1, "") and next(r for r in got if r["doc_id"] == 3)["text"] is None


def test_word_hashes_follow_the_words():
    texts = ["a b", "", "b", None, " x\ny  Z\n\nz", "q" * (wordhash.PIECE + 5) + " Z " + "q" * 9, "Ünï Ünï\x0bc", "w " * 70_000]
    seen = {}
    for lo, part in wordhash.parts(pa.array(texts), size=50):
        for i, got in enumerate(wordhash.words(part)):
            own = (texts[lo + i] or "").encode().lower().split()
            assert len(own) == len(got) and all(seen.setdefault(a, b) == b for a, b in zip(own, got.tolist(), strict=True))
    assert len(set(seen.values())) == len(seen) == 10


def test_chains_score_like_the_quadratic_recurrence():
    rng = random.Random(14)
    for _ in range(40):
        anchors = list({rng.randrange(80): rng.randrange(80) for _ in range(rng.randint(2, 25))}.items())
        best = {}
        for x, y in sorted(anchors, key=lambda a: (a[0], -a[1])):
            best[x, y] = substring_dedup.SEED + max([0.0, *(s - substring_dedup.GAP * (x - a + y - b) for (a, b), s in best.items() if a < x and b < y)])
        top = substring_dedup.chains(anchors)
        if top:
            c = top[0]
            assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(c, c[1:], strict=False))
            score = len(c) * substring_dedup.SEED - substring_dedup.GAP * (c[-1][0] - c[0][0] + c[-1][1] - c[0][1])
            assert score == pytest.approx(max(best.values()))


def test_passages_are_found_and_clean_texts_left_alone(make):
    rng = random.Random(15)
    p = words(70, rng)
    rows = [*EDGE, *((i, " ".join(words(80, rng))) for i in range(40))]
    for i in range(50, 62):
        a, b = words(40, rng), words(50, rng)
        rows.append((i, " ".join(a + edited(p, i % 3, rng) + b)))
    got = substring_dedup.repeated_passages(make(rows)).collect()
    by = {r["doc_id"]: r for r in got}
    assert set(by) == set(range(51, 62)) and {r["source_doc_id"] for r in got} <= set(range(50, 62))
    assert all(45 <= r["n_words"] <= 80 and 30 <= r["start_word"] <= 50 for r in got)
    assert substring_dedup.repeated_passages(make(rows).where("false")).count() == 0


def test_passages_far_apart_are_both_found(make):
    rng = random.Random(17)
    rows, want = [], set()
    for i, (here, there) in enumerate(((0, 40), (0, 80), (60, 60), (100, 100), (150, 150))):
        p, q, head = words(60, rng), words(60, rng), words(20, rng)
        rows += [(2 * i, " ".join(p + words(there, rng) + q)), (2 * i + 1, " ".join(head + p + words(here, rng) + q))]
        want |= {(2 * i + 1, x) for at in (20, 80 + here) for x in range(at, at + 60)}
    got = substring_dedup.repeated_passages(make(rows)).collect()
    found = {(r["doc_id"], x) for r in got for x in range(r["start_word"], r["start_word"] + r["n_words"])}
    assert want <= found and len(found - want) < 0.05 * len(want)


def test_looking_for_frequent_words_takes_little_memory():
    levels = bytes(line_dedup.TABLE - 1) + b"\x80"
    tracemalloc.start()
    try:
        assert line_dedup.frequent(None, levels).shape == (2, 0)
        assert tracemalloc.get_traced_memory()[1] < 2 * line_dedup.TABLE
    finally:
        tracemalloc.stop()


def test_a_passage_whose_seeds_all_occur_earlier_elsewhere_is_found(make):
    rng = random.Random(23)
    other = lambda n: [rng.choice("abcdefghij") + str(rng.randrange(100_000)) for _ in range(n)]
    passage, edited = other(60), other(60)
    changed = [w if i % 12 else "x" + w for i, w in enumerate(edited)]
    rows = [(i, " ".join(other(20) + text[k : k + 8] + other(20))) for i, (text, k) in enumerate((t, k) for t in (passage, edited) for k in range(0, 53))]
    pair = {200: passage, 201: passage, 202: edited, 203: changed}
    rows += [(i, " ".join(other(30) + text + other(30))) for i, text in pair.items()]
    got = {r["doc_id"]: r for r in substring_dedup.repeated_passages(make(rows)).collect()}
    # Document 200 repeats none of the others at length.
    assert set(got) == {201, 203}
    assert got[201]["source_doc_id"] == 200 and abs(got[201]["n_words"] - 60) <= 2
    assert got[203]["source_doc_id"] == 202 and got[203]["n_words"] >= 45


@pytest.mark.parametrize("many", [50, 1000])
def test_partners_of_a_seed_are_only_left_out_for_better_ones(monkeypatch, many):
    monkeypatch.setattr(substring_dedup, "MANY", many)
    rng = np.random.default_rng(7)
    n = 400
    base = rng.integers(0, 16, 32)
    words = np.where(rng.random((n, 32)) < rng.choice([0.1, 0.3, 0.9], n)[:, None], rng.integers(0, 16, (n, 32)), base)
    rows = np.zeros(n, substring_dedup.PLACE)
    code = lambda w: sum((w[:, i] >> k & 1).astype(np.uint64) << np.uint64(16 * k + i) for i in range(16) for k in range(4))
    rows["before"], rows["behind"], rows["at"], rows["key"], rows["seed"] = code(words[:, :16]), code(words[:, 16:]), np.arange(n), np.arange(n) // 2 + 1, 5
    got = {}
    rows["pos"] = np.arange(n)
    for r in substring_dedup.anchors_of(rows[rng.permutation(n)]):
        if r["like"]:
            got.setdefault(int(r["pos"]), set()).add(int(r["from"]))
    reach = lambda a, b: (substring_dedup._extension(zip(words[a, 15::-1], words[b, 15::-1])), substring_dedup._extension(zip(words[a, 16:], words[b, 16:])))  # noqa: E731,B905
    for j in range(n):
        able = {i: reach(i, j) for i in range(j) if i // 2 != j // 2}
        able = {i: x for i, x in able.items() if sum(x) + substring_dedup.SEED >= substring_dedup.LEAST_SPAN}
        mine = got.get(j, set())
        assert mine <= set(able)
        assert all(any(able[k][0] >= x[0] and able[k][1] >= x[1] for k in mine) for x in able.values())


def test_passages_with_edits_are_found(make):
    rng = random.Random(18)
    rows, edits = [], {}
    for i in range(120):
        every, p, start = (5, 6, 8, 10, 12, 15)[i % 6], words(60, rng), rng.randrange(5)
        q = [w + "x" if k % every == start % every else w for k, w in enumerate(p)]
        rows += [(2 * i, " ".join(words(30, rng) + p + words(30, rng))), (2 * i + 1, " ".join(words(30, rng) + q + words(30, rng)))]
        edits[2 * i + 1] = every
    got = {r["doc_id"] for r in substring_dedup.repeated_passages(make(rows)).collect()}
    recall = {e: sum(i in got for i in edits if edits[i] == e) / 20 for e in set(edits.values())}
    assert got <= set(edits) and all(recall[e] >= 0.95 for e in recall if e > 5) and recall[5] >= 0.8, recall


def test_mix_comes_near_targets(make):
    rng = random.Random(16)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["a", "b", "c", "d", None])) for i in range(900)]
    rows += [(2000, None, "a"), (2001, "", None), (2002, "same row", "b"), (2002, "same row", "b")]
    docs = make(rows).withColumn("size", F.lit("clash"))
    got = mix_sources.mix_sources(docs).collect()
    assert len(got) == len(rows)
    again = mix_sources.mix_sources(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    total, taken, target, size = sum(r["size"] for r in got), defaultdict(int), {}, {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] % max(1, r["size"]) == 0
        taken[r["source"]] += r["taken"]
        target[r["source"]], size[r["source"]] = r["target"], r["source_size"]
    weights = dict(zip(["a", "b", "c", "d", None], (1, 2, 3, 1, 2), strict=True))
    want = {s: total * w / 9 for s, w in weights.items()}
    for s in weights:
        assert target[s] == pytest.approx(min(want[s], 3 * size[s])) or any(want[x] > 3 * size[x] for x in weights)
        assert abs(taken[s] - target[s]) <= 31
    assert mix_sources.mix_sources(docs.where("false")).count() == 0


def test_repeated_rows_come_near_their_target(make):
    rows = [(1, "w " * 10, "a")] * 500 + [(1000 + i, "w " * 10, "b") for i in range(500)] + [(3000, "w", None)]
    docs = make(rows).withColumns({c: F.lit("kept") for c in ("rest", "edge", "q", "b", "last", "rank", "w", "cap", "pi", "_class")})
    got = mix_sources.mix_sources(docs).collect()
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert {r[c] for c in ("rest", "edge", "q", "b", "last", "rank", "w", "cap", "pi", "_class")} == {"kept"}
    target = {r["source"]: r["target"] for r in got}
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 10 for s in target), (taken, target)
    again = Counter((r["source"], r["doc_id"], r["copies"]) for r in mix_sources.mix_sources(docs.repartition(5)).collect())
    assert again == Counter((r["source"], r["doc_id"], r["copies"]) for r in got)


def test_larger_documents_have_better_odds(make):
    rng = random.Random(23)
    rows = [(i, " ".join(["w"] * rng.choice([4, 40, 400])), "a") for i in range(1500)] + [(9000 + i, "w " * 100, "b") for i in range(1000)]
    got = [r for r in mix_sources.mix_sources(make(rows)).collect() if r["source"] == "a"]
    share = {n: sum(r["copies"] for r in got if r["size"] == n) / sum(r["size"] == n for r in got) for n in (4, 40, 400)}
    assert share[4] < share[40] < share[400], share


def test_capped_targets_are_reshared(make):
    rows = [(i, "w " * 10, "big") for i in range(90)] + [(100 + i, "w", "tiny") for i in range(5)] + [(200, "w w", "x")]
    got = {r["source"]: r["target"] for r in mix_sources.mix_sources(make(rows)).collect()}
    assert got["tiny"] == 15 and got["x"] == 6 and got["big"] == pytest.approx(907 - 21)


def test_pipeline_stages(spark, tmp_path):
    rows = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert len(out) and (out["length"] <= 2048).all() and len(corpus_pipeline.STAGES) == 5
