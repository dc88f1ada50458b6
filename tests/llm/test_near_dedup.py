import hashlib
import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from verdigris.llm import near_dedup as M
from verdigris.llm.components import components

from compare import SMALL

WORDS = [f"w{i}" for i in range(5000)]


def near(words, edits, rng):
    out = list(words)
    at = rng.randrange(len(out) - edits)
    out[at : at + edits] = [f"z{rng.random()}" for _ in range(edits)]
    return out


def test_samples_estimate_weighted_jaccard():
    rng = random.Random(0)
    idf = M.FLAT
    hits, want = [], []
    for _ in range(60):
        a = [rng.choice(WORDS) for _ in range(300)] * 2
        b = near(a, 60, rng)
        bags = [M.bag(" ".join(x), idf) for x in (a, b)]
        s = M.samples(np.concatenate([x[0] for x in bags]), np.concatenate([x[1] for x in bags]), np.array([0, len(bags[0][0])]))
        hits.append((s[0] == s[1]).mean())
        want.append(M.weighted_jaccard(*bags))
    assert abs(np.mean(hits) - np.mean(want)) < 0.03


def test_shingles():
    assert len(M.shingles("")) == 0 == len(M.shingles(" \n\x0b"))
    assert len(M.shingles("a b c")) == 1 and len(M.shingles("a b c d e f")) == 2
    assert (M.shingles(" a\tb  c d\ne ") == M.shingles("a b c d e")).all()
    assert M.shingles("a b c d e")[0] != M.shingles("a b c e d")[0]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def corpus():
    rng = random.Random(2)
    texts = [[rng.choice(WORDS) for _ in range(300)] for _ in range(40)]
    groups = [[x] for x in texts]
    for g in groups[:8]:
        g += [near(g[0], 8, rng) for _ in range(3)]
    rows, truth = [], {}
    for n, g in enumerate(groups):
        for x in g:
            truth[len(rows)] = n
            rows.append(" ".join(x))
    for extra in (rows[0], None, "", "one two", "one two"):
        truth[len(rows)] = {rows[0]: 0, None: "none", "": "none", "one two": "two"}[extra]
        rows.append(extra)
    return rows, truth


def test_classes_of_planted_copies(spark):
    rows, truth = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, root string")
    got = {r.doc_id: r for r in M.near_classes(df).collect()}
    assert len(got) == len(rows)
    for i in truth:
        assert got[i]._class == min(j for j in truth if truth[j] == truth[i])
        assert got[i]._kept == (got[i]._class == i)


def test_large_families_give_the_same_links(spark):
    rows, _ = corpus()
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    groups = lambda f: sorted(sorted(bytes(r._t) for r in f.collect() if bytes(r.root) == x) for x in {bytes(r.root) for r in f.collect()})
    assert groups(M.classes(df, family=2)) == groups(M.classes(df))


def test_repeated_rows_keep_one(spark):
    df = spark.createDataFrame([(1, "same text"), (1, "same text"), (None, "same text")], "doc_id long, text string")
    assert sum(r._kept for r in M.near_classes(df).collect()) == 1
    assert M.near_classes(df.limit(0)).count() == 0


def test_pairs_in_large_buckets_of_a_template(spark):
    """Texts that share a template just under the threshold, with pairs over it, in buckets far larger than PIVOTS chunks reach."""
    rng = random.Random(3)
    template = [rng.choice(WORDS) for _ in range(900)]
    new = lambda n: [f"z{rng.random()}" for _ in range(n)]
    rows = []
    for _ in range(150):
        both = new(105)
        rows += [" ".join(template + both + new(4)) for _ in range(2)]
    idf = M.inverse_frequencies(*sketch(rows))
    bags = [M.bag(t, idf) for t in rows]
    assert M.weighted_jaccard(bags[0], bags[1]) > 0.9 > M.THRESHOLD > M.weighted_jaccard(bags[0], bags[2]) > 0.7
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    digest = [hashlib.md5(t.encode()).digest() for t in rows]
    got = {bytes(r._t): bytes(r.root) for r in M.classes(df, family=6).collect()}
    assert got == {digest[i]: min(digest[i], digest[i ^ 1]) for i in range(len(rows))}


def test_links_across_leaves_sides_and_roots():
    texts = [" ".join(f"w{i}" for i in range(300)) + f" z{k}" for k in range(4)]
    idf = M.FLAT
    bags = [M.bag(t, idf) for t in texts]
    sig = M.samples(np.concatenate([b[0] for b in bags]), np.concatenate([b[1] for b in bags]), np.cumsum([0, *(len(b[0]) for b in bags[:-1])]))
    sigs = [x.tobytes() for x in sig]
    across = lambda roots, sides: M.links_across(texts, sigs, roots, sides, 0, idf)
    assert across([b"a", b"b", b"c", b"d"], [-1] * 4) == [(0, 1), (0, 2), (0, 3)]
    assert across([b"a", b"a", b"c", b"c"], [-1] * 4) == [(0, 2)]
    assert across([b"a", b"b", b"c", b"d"], [0] * 4) == []
    assert across([b"a", b"b", b"c", b"d"], [0, 0, 1, 1]) == [(0, 2), (0, 3), (1, 2)]


def sketch(rows, seed=0):
    """What document_frequencies gathers, by a dictionary."""
    texts = list(dict.fromkeys(rows))
    least = [M.least_hashes(M.shingles(t), seed).tolist() for t in texts]
    holders = Counter((k, h) for x in least for k, h in enumerate(x))
    df = Counter()
    for t, x in zip(texts, least, strict=True):
        share = 1 / (1 + sum(holders[k, h] - 1 for k, h in enumerate(x)) / M.LEAST_HASHES)
        for e in np.unique(M.shingles(t) >> np.uint64(64 - M.KEY_BITS)).tolist():
            df[e] += share
    floor = max(1.0, sum(len(M.shingles(t)) for t in rows) / M.COMMON)
    some = sorted((e, x) for e, x in df.items() if x > floor)
    return M.Frequencies(np.array([e for e, _ in some], np.uint64), np.array([x for _, x in some]), floor), len(rows)


def test_frequencies_count_copies_once(spark):
    """A line of many documents weighs less than others, a text of many copies doesn't."""
    rng = random.Random(7)
    new = lambda n: " ".join(f"z{rng.random()}" for _ in range(n))
    common, copied = new(5), new(60)
    rows = [f"{new(30)} {common}" for _ in range(400)] + [copied] * 400
    slots, n = M.document_frequencies(spark.createDataFrame([(t,) for t in rows], "_text string"))
    idf = M.inverse_frequencies(slots, n)
    weight = lambda text: float(np.median(idf.of(M.shingles(text))))
    assert n == 800 and abs(weight(common) - math.log(3)) < 0.1
    assert abs(weight(copied) - weight(new(60))) < 0.1 and weight(copied) > 6
    want = sketch(rows)[0]
    assert (slots.keys == want.keys).all() and np.allclose(slots.df, want.df, atol=1e-3) and len(want.keys) and slots.floor == want.floor


def test_frequencies_of_large_corpora(spark, monkeypatch):
    """Several ranges of hashes, several sums of a task, and a floor: all as in one dictionary."""
    monkeypatch.setattr(M, "COMMON", 1000)
    monkeypatch.setattr(M, "RANGE_BYTES", 1000)
    monkeypatch.setattr(M, "SUMMED", 50)
    rng = random.Random(9)
    rows = [" ".join(rng.choice(WORDS[:3]) for _ in range(20)) for _ in range(120)]
    got, n = M.document_frequencies(spark.createDataFrame([(t,) for t in rows], "_text string"))
    want, _ = sketch(rows)
    assert n == 120 and 0 < len(want.keys) <= 1000 and want.floor > 1
    assert (got.keys == want.keys).all() and np.allclose(got.df, want.df)
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << M.KEY_BITS, 100, dtype=np.uint64))
    assert (M._unpacked(M._packed(keys)) == keys).all()


def test_classes_do_not_hang_on_the_hash(spark):
    """A template of most of each text, with pairs over the threshold: two seeds of the group sizes give like weights and equal classes."""
    rng = random.Random(3)
    template = [rng.choice(WORDS) for _ in range(900)]
    new = lambda n: [f"z{rng.random()}" for _ in range(n)]
    rows = []
    for _ in range(40):
        both = new(150)
        rows += [" ".join(template + both + new(4)) for _ in range(2)]
    likeness = []
    for seed in range(5):
        idf = M.inverse_frequencies(*sketch(rows, seed))
        bags = [M.bag(t, idf) for t in rows[:4]]
        likeness.append(M.weighted_jaccard(bags[0], bags[2]))
    assert max(likeness) - min(likeness) < 0.03
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    classes = [{bytes(r._t): bytes(r.root) for r in M.classes(df, seed=seed).collect()} for seed in (1, 2)]
    assert classes[0] == classes[1] and len(classes[0]) == len(rows)


def test_classes_against_all_pairs(spark):
    """Recall and precision of the classes of the smallest tables against the weighted Jaccard similarity of all pairs."""
    texts = [r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    rng = random.Random(8)
    for t in list(texts[:60]):
        words = t.split(" ")
        for share in (0.01, 0.03, 0.05, 0.1):
            w = list(words)
            for i in rng.sample(range(len(w)), int(len(w) * share / 2)):
                w[i] = f"y{rng.random()}"
            texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    slots, n = M.document_frequencies(df.select(F.col("text").alias("_text")))
    idf = M.inverse_frequencies(slots, n)
    bags = [M.bag(t, idf) for t in texts]
    near = {(i, j) for j in range(len(texts)) for i in range(j) if texts[i] == texts[j] or M.weighted_jaccard(bags[i], bags[j]) >= M.THRESHOLD}
    assert len(near) > 100
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in near:
        a, b = root(i), root(j)
        parent[max(a, b)] = min(a, b)
    got = {r.doc_id: r._class for r in M.near_classes(df).collect()}
    together = sum(got[i] == got[j] for i, j in near)
    assert together >= 0.99 * len(near)
    assert all(root(got[i]) == root(i) for i in got)  # nothing else is linked


def test_clashing_names(spark):
    df = spark.createDataFrame([(f"id{i}", "one two three four five six", 1, 2, 3, 4) for i in range(2)], "doc_id string, text string, t int, row int, number int, _t int")
    rows = M.near_classes(df).collect()
    assert sorted((r.doc_id, r.t, r.row, r.number, r._t, r._class, r._kept) for r in rows) == [("id0", 1, 2, 3, 4, "id0", True), ("id1", 1, 2, 3, 4, "id0", False)]
