import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from verdigris.llm import suffix_dedup as M


def brute(texts, size, first=False):
    """(n_bytes, n_removed, n_spans, digest) by looking at every string of size bytes."""
    data = [(t or "").encode() for t in texts]
    count = {}
    for d in data:
        for i in range(len(d) - size + 1):
            count[d[i : i + size]] = count.get(d[i : i + size], 0) + 1
    out, met = [], set()
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - size + 1):
            w = d[i : i + size]
            if (w in met) if first else count[w] > 1:
                gone[i : i + size] = b"\1" * size
            met.add(w)
        rest = bytes(c for c, g in zip(d, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(d)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(d), len(d) - len(rest), spans, hashlib.sha256(rest).hexdigest()))
    return out


def corpus():
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [word(rng.randint(380, 900)) for _ in range(4)]
    texts = [None, "", "a" * 3000, "a" * 500, "ab" * 400, "b" * 399]
    for _ in range(20):
        x = word(rng.randint(0, 700))
        for _ in range(rng.randint(0, 2)):
            x += rng.choice(shared) + word(rng.randint(0, 500))
        texts.append(x)
    return [*texts, texts[12], texts[12], texts[13][:-3]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=60), min_size=1, max_size=5), st.integers(8, 20))
def test_factors_equal_brute_force(texts, size):
    """Every longest previous and next factor against all pairs of places; factors end with their text."""
    data = [t.encode() for t in texts if t]
    ends = np.cumsum([len(t) for t in data]).astype(np.int64)
    flat = np.frombuffer(b"".join(data), np.uint8)
    places = [t[i:] for t in data for i in range(len(t))]
    share = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    cut = lambda n: n if n >= size else 0
    earlier, later = M.factors(flat, ends, size)
    assert earlier.tolist() == [cut(max((share(x, y) for y in places[:i]), default=0)) for i, x in enumerate(places)]
    assert later.tolist() == [cut(max((share(x, y) for y in places[i + 1 :]), default=0)) for i, x in enumerate(places)]


def test_equal_windows_share_a_key():
    rng = random.Random(1)
    passage = bytes(rng.choice(b"abcdef ") for _ in range(450)).decode()
    keys = []
    for left in (0, 7, 333):
        text = ("x" * left + passage + "y" * left).encode()
        at, n, key, _, _ = M.blocks_of(text)
        keys.append([k for a, m, k in zip(at, n, key, strict=True) for s in range(a, a + m) if left <= s <= left + 50])
    assert keys[0] == keys[1] == keys[2]


@pytest.mark.parametrize("hot", [2_000, 2])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(M, "HOT_BLOCKS", hot)
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(M, "table", lambda *_: df)
    rows = sorted(M.op1_suffix_dedup(spark, "").collect())
    assert [tuple(r[:5]) for r in rows] == [(i, *w) for i, w in enumerate(brute(texts, 400))]
    assert all(r.repeats == (r.n_removed > 0 or r.n_passages > 0) for r in rows)
    kept = sorted((r.doc_id, r._n_removed, r._n_spans) for r in M.dedup_substrings(df).collect())
    assert kept == [(i, w[1], w[2]) for i, w in enumerate(brute(texts, 400, first=True))]


def test_other_columns_and_empty_frames(spark):
    df = spark.createDataFrame([(None, "z" * 450, 1), (None, "z" * 450, 2)], "doc_id long, text string, n_removed int")
    rows = M.dedup_substrings(df).collect()
    assert sorted(r.n_removed for r in rows) == [1, 2] and sorted(len(r.text) for r in rows)[0] == 0
    assert M.dedup_substrings(df.limit(0)).count() == 0


def test_string_ids_and_clashing_names(spark):
    texts = ["q" * 30 + "xyz" * 200, "p" * 25 + "xyz" * 200, None, "q" * 30 + "xyz" * 200]
    df = spark.createDataFrame([(f"id-{9 - i}", t, 1, 2, 3, 4) for i, t in enumerate(texts)], "doc_id string, text string, t int, o int, row int, _t int")
    rows = {r.doc_id: r for r in M.dedup_substrings(df).collect()}
    assert {(r.t, r.o, r.row, r._t) for r in rows.values()} == {(1, 2, 3, 4)}
    assert rows["id-6"].text == texts[3][: 30 + 3 * 200] or rows["id-6"]._n_removed > 0
    assert rows["id-9"].text == "" and rows["id-7"].text == "" and 25 <= len(rows["id-8"].text) < 625


def brute_words(texts, size):
    """The words that stay of each text, of equal runs of size words the first."""
    met, out = set(), []
    for words in ((t or "").split() for t in texts):
        gone = [False] * len(words)
        for i in range(len(words) - size + 1):
            w = tuple(words[i : i + size])
            if w in met:
                gone[i : i + size] = [True] * size
            met.add(w)
        out.append([w for w, g in zip(words, gone, strict=True) if not g])
    return out


@pytest.mark.parametrize("hot", [2_000, 2])
def test_runs_of_words_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(M, "HOT_BLOCKS", hot)
    rng = random.Random(6)
    new = lambda n: [rng.choice("aé") + str(rng.randrange(10**rng.choice((1, 5)))) for _ in range(n)]
    shared = [new(n) for n in (50, 51, 52, 58, 65, 200)]
    texts = [None, "", "a " * 300, "a b " * 60, " ".join(new(50))]
    for _ in range(25):
        x = new(rng.randint(0, 70))
        for _ in range(rng.randint(0, 3)):
            x += rng.choice(shared) + new(rng.randint(0, 70))
        texts.append(rng.choice((" ", "\n", " \t")).join(x))
    texts += [texts[9], " ".join(shared[3]), "x " + "\n".join(shared[3]) + " y", texts[4]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text.split() for r in M.dedup_substrings(df, min_words=51).collect()}
    assert got == dict(enumerate(brute_words(texts, 51)))


class Counted(np.ndarray):
    """An array that counts the elements of the ufuncs on it."""

    done = 0

    def __array_ufunc__(self, ufunc, method, *args, **kwargs):
        Counted.done += self.size
        return getattr(ufunc, method)(*[np.asarray(x) for x in args], **kwargs)


def test_a_bucket_is_read_once_not_for_each_block(monkeypatch):
    rng = random.Random(9)
    shared = bytes(rng.choice(b"abcdef ") for _ in range(430))
    blocks = [bytes([65 + i % 20]) * (i % 7) + shared[: 405 + i % 20] + b"%d" % i for i in range(200)]
    rows = {"key": [1] * 200, "h": list(range(200)), "o": list(range(200)), "at": [0] * 200, "block": blocks}
    group = M.pa.table(rows, schema=M.pa.schema([("key", "int64"), ("h", "int64"), ("o", "int64"), ("at", "int64"), ("block", "binary")]))
    plain = M.factors
    monkeypatch.setattr(M, "factors", lambda *a: tuple(x.view(Counted) for x in plain(*a)))
    Counted.done = 0
    out = M._order_bucket(group, 400, False, False).to_pylist()
    count = Counter(b[i : i + 400] for b in blocks for i in range(len(b) - 399))
    got = [sorted(i for r in row["runs"] for i in range(r["a"], r["b"])) for row in out]
    assert got == [[i for i in range(len(b) - 399) if count[b[i : i + 400]] > 1] for b in blocks]
    assert Counted.done < 10 * sum(map(len, blocks))


@pytest.mark.parametrize("words", [False, True])
def test_short_texts_are_hashed_together(monkeypatch, words):
    """Blocks, by text, as each text alone has them; with hashing passes by bytes of text, not by text."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab  \n") for _ in range(rng.choice((0, 399, 400, 900)))) + "é" * rng.randrange(3) for _ in range(300)]
    texts += ["ab " * 400, "", "x" * 5_000, " ".join(texts[:40])]
    monkeypatch.setattr(M, "SEGMENT", 3_000)
    least, gram = (51, M.WORD_GRAM) if words else (400, M.GRAM)
    want = [M.blocks_of(M._coded(t, words), least, gram, words) for t in texts]
    passes, plain = [], M._gram_hashes
    monkeypatch.setattr(M, "_gram_hashes", lambda *a: passes.append(1) or plain(*a))
    batch = M.pa.RecordBatch.from_pydict({"t": [b"%d" % i for i in range(len(texts))], "o": list(range(len(texts))), "text": texts})
    rows = [r for b in M._mark(iter([batch]), least, words) for r in b.to_pylist()]
    assert [tuple(r[c] for c in ("at", "n", "key", "h", "again")) for r in rows] == want
    assert any(w[0] for w in want) and len(passes) < 30
