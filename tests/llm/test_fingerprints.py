import hashlib
import re

from verdigris.llm import fingerprints as M

from compare import SMALL


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_estimates_and_neighbours(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").toPandas()
    got = M.op3_fingerprints(spark, SMALL).toPandas().sort_values("doc_id").reset_index(drop=True)
    texts, errors, seen = docs.text.tolist(), [], {}
    for i, t in enumerate(texts):
        n = texts[(i + 1) % len(texts)]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + n[:cut]
        assert got.edited_sha256[i] == hashlib.sha256(edited.encode()).hexdigest() and got.n_chars[i] == len(t)
        a, b = shingles(t), shingles(edited)
        errors.append(got.near_edited[i] - len(a & b) / len(a | b))
        assert seen.setdefault(t, got.fingerprint[i]) == got.fingerprint[i]
    assert abs(sum(errors) / len(errors)) < 0.02 and max(map(abs, errors)) < 0.2
    assert set(map(len, got.fingerprint)) == {M.BINS * M.BITS // 4}


def test_edges(spark):
    df = spark.createDataFrame([(5, "a b c d e f g"), (3, ""), (3, None), (None, "x"), (9, " ")], "doc_id long, text string")
    rows = M.fingerprint_neighbours(df).collect()
    assert sorted(r.n_chars for r in rows) == [0, 0, 1, 1, 13]
    assert len({r.fingerprint for r in rows if r.doc_id in (3, 9)}) == 1
    alone = M.fingerprint_neighbours(df.where("doc_id = 5")).first()
    assert alone.near_next == 1.0
    assert M.fingerprint_neighbours(df.limit(0)).count() == 0
    same = spark.createDataFrame([(1, "q"), (1, "q"), (1, "q")], "doc_id long, text string")
    assert [r.near_next for r in M.fingerprint_neighbours(same).collect()] == [1.0] * 3


def test_no_python_on_executors(spark):
    plan = M.op3_fingerprints(spark, SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
