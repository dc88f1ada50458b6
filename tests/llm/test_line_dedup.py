import re
from collections import Counter

import pytest

import compare
from verdigris.llm import line_dedup as M

from compare import SMALL


def brute(texts, least):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\f\r"))
    lines = [(t or "").split("\n") for t in texts]
    docs = Counter(k for ls in lines for k in {key(x) for x in ls} if k)
    return [(len(ls), sum(docs[key(x)] >= least for x in ls if key(x)), "\n".join(x for x in ls if not key(x) or docs[key(x)] < least)) for ls in lines]


def test_against_sql(spark):
    got, want = compare.both(spark, compare.connect(SMALL), M.op5_line_dedup, M.ORACLE, SMALL)
    assert got == want


@pytest.mark.parametrize("batches", [1, 3, 5])
def test_against_brute_force(spark, batches):
    texts = [None, "", "\n", "A\nb", " a \nB\nc", "a\n\na", "ÀB\nàb", "\u00a0a", "a\x0b", "x" * 5000 + "\na", "a\nq", "a\nq"]
    df = spark.createDataFrame([(i, t, "keep") for i, t in enumerate(texts)], "doc_id long, text string, _n_words string")
    rows = sorted(M.dedup_lines(df, min_docs=3, batches=batches).collect(), key=lambda r: r.doc_id)
    assert [(r._n_lines, r._n_dropped, r.text) for r in rows] == brute(texts, 3)
    assert {r._n_words for r in rows} == {"keep"}


def test_runs_compact(spark):
    runs = M.LineRuns(spark, 2)
    for _ in range(4):
        runs.add(spark.createDataFrame([(bytearray(b"k"), 1)], "key binary, n long"), 100)
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    assert runs.counts().first().n == 4
    more = spark.createDataFrame([(1, "v\nw")], "doc_id long, text string")
    again = M.dedup_lines(more, min_docs=2, runs=M.LineRuns(spark))
    assert again.first()._n_dropped == 0


def test_empty(spark):
    assert M.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_runs_outlive_their_session(spark, tmp_path):
    """Earlier documents count, each batch once, also from a folder read again."""
    one = spark.createDataFrame([(1, "v\nw"), (2, "v\nx")], "doc_id long, text string")
    runs = M.LineRuns(spark, folder=str(tmp_path))
    for _ in range(2):
        out = M.dedup_lines(one, min_docs=3, runs=runs, name="first")
        assert sorted(r._n_dropped for r in out.collect()) == [0, 0]
    again = M.LineRuns(spark, folder=str(tmp_path))
    assert again.levels == runs.levels and sorted(r.n for r in again.counts().collect()) == [1, 1, 2]
    more = M.dedup_lines(spark.createDataFrame([(3, "V \ny")], "doc_id long, text string"), min_docs=3, runs=again, name="second")
    assert more.first().text == "y"


def test_clashing_names(spark):
    df = spark.createDataFrame([(i, "same\nl%d" % i, "a", "b", "c", 1) for i in range(3)], "doc_id long, body string, t string, text string, row string, _n_lines int")
    rows = M.dedup_lines(df, "body", min_docs=3).collect()
    assert sorted((r.doc_id, r.body, r.t, r.text, r.row, r._n_lines) for r in rows) == [(i, f"l{i}", "a", "b", "c", 2) for i in range(3)]


def test_keys_stay_distinct():
    """The Latin-1 form keeps what UTF-8 tells apart, in A-Z's case alone alike."""
    lower = lambda x: x.encode().decode("latin-1").lower()
    points = [*range(32, 0x3000), *range(0xE000, 0xE800), *range(0x1F300, 0x1F400), *range(0xFFF0, 0x10010)]
    forms = {}
    for p in points:
        forms.setdefault(lower(chr(p)), set()).add(re.sub("[A-Z]", lambda m: m[0].lower(), chr(p)))
    assert all(len(x) == 1 for x in forms.values())


def test_many_lines_of_one_text(spark):
    """Places of the lines that go, first and last among them, in a long text."""
    lines = [f"line {i}" if i % 3 else "common" for i in range(2_000)]
    rows = [("\n".join([*lines, f"end {k}", "common"]),) for k in range(10)]
    got = M.dedup_lines(spark.createDataFrame(rows, "text string")).collect()
    assert sorted(r.text for r in got) == [f"end {k}" for k in range(10)] and {r._n_dropped for r in got} == {2_001}


def test_names_of_batches(spark):
    runs = M.LineRuns(spark)
    first, second = (spark.createDataFrame([(f"{x}{i}\nshared",) for i in range(6)], "text string") for x in "ab")
    assert {r._n_dropped for r in M.dedup_lines(first, runs=runs, name="a").collect()} == {0}
    assert {r._n_dropped for r in M.dedup_lines(first, runs=runs, name="a").collect()} == {0}  # the same again
    with pytest.raises(ValueError):
        M.dedup_lines(second, runs=runs, name="a")
    assert {r._n_dropped for r in M.dedup_lines(second, runs=runs).collect()} == {1}  # named by what it holds
    assert {r._n_dropped for r in M.dedup_lines(first.limit(2), runs=runs).collect()} == {1}
