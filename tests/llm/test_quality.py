import math
import random
import re
from collections import Counter

from verdigris.llm import quality as M

from compare import SMALL


def brute(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    marked = {j for i in range(len(w) - 2) if grams[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(marked)


def test_binomial_bounds():
    for k, n, p in ((0, 10, 0.1), (3, 20, 0.2), (50, 400, 0.1), (7, 7, 0.5)):
        exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert abs(M.binomial_tail(k, n, p) - exact) < 1e-9
    assert abs(M.upper_bound(0, 100, 0.05) - (1 - 0.05**0.01)) < 1e-9
    assert M.upper_bound(0, 0, 0.05) == 1.0 and M.upper_bound(5, 5, 0.05) == 1.0


def test_counts_against_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t", "a", "a a a a", "a b c a b c d a b", "é|# é|#\né|# é|#", "x" * 9000, "w " * 3000]
    texts += [" ".join(rng.choice("abcd") for _ in range(rng.randint(1, 40))) for _ in range(40)]
    df = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    rows = sorted(M.measured(df).collect(), key=lambda r: r.doc_id)
    for r, t in zip(rows, texts, strict=True):
        b = brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b
        assert r.base_failed == (b[0] < 50 or 100 * b[4] > 50 * b[0])


def corpus(spark, good=600, bad=200):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    rows = [(i, "en", " ".join(word() for _ in range(80)), 1) for i in range(good)]
    rows += [(good + i, "en", " ".join(word() + "###" for _ in range(80)), 0) for i in range(bad)]
    rows += [(10_000 + i, None, " ".join(word() + "###" for _ in range(80)), 0) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string, quality int")
    return df.drop("quality"), df.select("doc_id", "quality").unionByName(spark.createDataFrame([(0, None), (None, 1), (1, 1)], "doc_id long, quality int"))


def test_cutoffs_reject_junk_and_keep_the_good(spark):
    docs, labels = corpus(spark)
    out = {r.doc_id: r.kept for r in M.judged(docs, labels).collect()}
    assert sum(not out[i] for i in range(600)) <= M.ALPHA * 600
    assert sum(not out[i] for i in range(600, 800)) >= 190
    assert all(out[10_000 + i] for i in range(5))  # a stratum with too few labels has no rule
    assert sorted(r.doc_id for r in M.filter_quality(docs, labels).collect()) == sorted(i for i, k in out.items() if k)


def test_no_labels_no_rule(spark):
    docs, labels = corpus(spark, 20, 5)
    assert M.cutoffs(M.measured(docs), labels.limit(0)) == {}
    assert M.judged(docs.limit(0), labels).count() == 0


def test_query(spark):
    out = M.op6_quality_rules(spark, SMALL)
    assert out.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert "Python" not in out._jdf.queryExecution().toString()
    assert out.where("base_failed and kept").count() == 0


def test_texts_of_more_words_than_the_position_bits_hold(spark, monkeypatch):
    monkeypatch.setattr(M, "_POS_BITS", 4)
    monkeypatch.setattr(M, "_POS_MASK", 15)
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcd") for _ in range(n)) for n in (10, 17, 18, 19, 20, 60, 300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_repeat_words for r in M.measured(df).collect()} == {i: brute(t)[4] for i, t in enumerate(texts)}


def test_windows_whose_upper_bits_agree(spark, monkeypatch):
    """With four bits of hash above the position, differing windows stand between equal ones in every text."""
    monkeypatch.setattr(M, "_POS_BITS", 60)
    monkeypatch.setattr(M, "_POS_MASK", (1 << 60) - 1)
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(n)) for n in (3, 60, 200, 300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_repeat_words for r in M.measured(df).collect()} == {i: brute(t)[4] for i, t in enumerate(texts)}


def brute_kept(spark, docs, labels):
    """The verdicts by plain loops: cutoffs picked on one half of each stratum's labels, proven on the other."""
    truth = {}
    for i, q in labels:
        if i is not None and q is not None:
            truth[i] = max(truth.get(i, 0), q)
    half = {r[0]: r[1] for r in spark.createDataFrame([(i,) for i in truth], "i long").selectExpr("i", "pmod(xxhash64('half', i), 2) = 0").collect()}
    rows = []
    for i, lang, t in docs:
        n, chars, symbols, dups, repeats = brute(t)
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        over = lambda a, b: a / b if b else 0.0
        features = {
            "symbol_ratio": over(symbols, chars), "dup_line_ratio": over(dups, len(lines)), "repeat_ratio": over(repeats, n),
            "upper_ratio": over(len(re.findall("[A-Z]", t or "")), chars), "bang_ratio": over((t or "").count("!"), n), "word_length": over(chars, n),
        }
        rows.append((i, lang, n < 50 or 100 * repeats > 50 * n, features))
    known = [r for r in rows if not r[2] and r[0] in truth]
    strata = {r[1] for r in known if half[r[0]]}
    rules = {}
    for s in strata:
        fit = [r for r in known if r[1] == s and half[r[0]]]
        proof = [r for r in known if r[1] == s and not half[r[0]]]
        good = sum(truth[r[0]] == 1 for r in fit)
        best = 0
        for tolerance in M.TOLERANCES:
            rule = {}
            for k, grid in M.GRIDS.items():
                cut = next((x for x in grid if sum(truth[r[0]] == 1 and r[3][k] > x for r in fit) <= tolerance * good), None)
                if cut is not None and any(truth[r[0]] == 0 and r[3][k] > cut for r in fit):
                    rule[k] = cut
            fails = lambda r, rule=rule: any(r[3][k] > x for k, x in rule.items())
            n = sum(truth[r[0]] == 1 for r in proof)
            wrong, hits = (sum(truth[r[0]] == q and fails(r) for r in proof) for q in (1, 0))
            if rule and n and M.upper_bound(wrong, n, M.DELTA / (len(strata) * len(M.TOLERANCES))) <= M.ALPHA and hits > best:
                rules[s], best = rule, hits
    return {i: not failed and not any(f[k] > x for k, x in rules.get(lang, {}).items()) for i, lang, failed, f in rows}, rules


def test_verdicts_against_brute_force(spark):
    docs, labels = corpus(spark)
    want, rules = brute_kept(spark, [tuple(r) for r in docs.collect()], [tuple(r) for r in labels.collect()])
    assert {r.doc_id: r.kept for r in M.judged(docs, labels).collect()} == want and rules
    table = lambda n, *c: [tuple(r) for r in spark.read.parquet(f"{SMALL}/{n}.parquet").select(*c).collect()]
    want, _ = brute_kept(spark, table("documents", "doc_id", "lang", "text"), table("labels", "doc_id", "quality"))
    assert {r.doc_id: r.kept for r in M.op6_quality_rules(spark, SMALL).collect()} == want


def test_clashing_names(spark):
    docs, labels = corpus(spark, 4, 2)
    odd = docs.selectExpr("*", "1 as row", "2 as _words", "3 as kept", "4 as _stratum", "5 as n_words")
    assert {(r.row, r._words, r._stratum) for r in M.judged(odd, labels).collect()} == {(1, 2, 4)}
    kept = M.filter_quality(odd, labels).collect()
    assert kept and all((r.row, r._words, r.kept, r._stratum, r.n_words) == (1, 2, 3, 4, 5) for r in kept)
