import hashlib
from collections import Counter

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from verdigris.llm import alignment as M

from compare import SMALL

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, "a", "a<|endoftext|>b", "<s> </s><0x41>", "▁ is not a space", "naïve 你好 🎉\n\tx  y", "\u0000 \x01", "same text here", "same text here", "x" * 2000]


def brute(docs):
    """The contract, token by token."""
    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    spelled = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in spelled} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in spelled)}
    entry = {i: bytes(byte[c] for c in t) for t, i in library.get_vocab().items() if t != "<|endoftext|>"}
    out, pairs = [], Counter()
    for doc_id, text in docs:
        text = text or ""
        a = library.encode(" " + text, add_special_tokens=False).ids if text else []
        b = model.encode(text) if text else []
        a_bytes = [entry[i] for i in a]
        b_bytes = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        whole = (" " + text).encode() if text else b""
        if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            a, b = [], []
        links, groups, i, j, at_a, at_b, ga, gb = [], [], 0, 0, 0, 0, [], []
        while i < len(a) and j < len(b):
            if not ga or ga[-1][0] != i:
                ga.append((i, a[i]))
            if not gb or gb[-1][0] != j:
                gb.append((j, b[j]))
            links.append((a[i], b[j]))
            end_a, end_b = at_a + len(a_bytes[i]), at_b + len(b_bytes[j])
            if end_a <= end_b:
                i, at_a = i + 1, end_a
            if end_b <= end_a:
                j, at_b = j + 1, end_b
            if end_a == end_b:
                groups.append(",".join(str(x) for _, x in ga) + "|" + ",".join(str(x) for _, x in gb))
                ga, gb = [], []
        pairs.update(set(links))
        out.append((doc_id, len(a), len(b), groups, links))
    best = {}
    for (a, _), n in pairs.items():
        best[a] = max(best.get(a, 0), n)
    return [
        (k, n_a, n_b, len(g), len(x), sum(pairs[p] == best[p[0]] for p in x), sum(pairs[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for k, n_a, n_b, g, x in out
    ]


def tuples(rows):
    return sorted((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows)


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert tuples(M.op11_token_alignment(spark, SMALL).collect()) == sorted(brute(docs))


def test_odd_texts(spark, tmp_path):
    docs = list(enumerate(ODD))
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 as row", "2 as a").write.parquet(f"{tmp_path}/documents.parquet")
    want = brute(docs)
    assert tuples(M.op11_token_alignment(spark, str(tmp_path)).collect()) == sorted(want)
    assert [x[1] for x in want if x[0] in (0, 1, 5)] == [0, 0, 0] and want[3][1] > 3


def test_shuffled_counts_are_the_same(spark):
    rows = M.align(spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))
    once = {r.doc_id: tuple(r) for r in M.link_counts(rows, "doc_id").collect()}
    assert once == {r.doc_id: tuple(r) for r in M.link_counts(rows, "doc_id", broadcast_pairs=0).collect()} and len(once) > 5


def test_best_of_either_side(spark):
    df = spark.createDataFrame([(1, [1, 1], [5, 6], [2, 1]), (2, [1, 2], [5, 6], [1, 1])], "id long, a array<int>, b array<int>, times array<int>")
    counts = {(r.a, r.b): (r.n, r.best_a, r.best_b) for r in M.pair_counts(df).collect()}
    assert counts == {(1, 5): (2, 2, 2), (1, 6): (1, 2, 1), (2, 6): (1, 1, 1)}
    assert {r.id: tuple(r)[1:] for r in M.link_counts(df, "id").collect()} == {1: (2, 3, 5), 2: (2, 2, 3)}


def test_ids_of_any_kind_and_no_rows(spark):
    df = spark.createDataFrame([("x", "one two"), (None, "one two")], "id string, text string")
    rows = M.align(df, "id").collect()
    assert sorted((r.id or "", r.groups) for r in rows) == sorted((r.id or "", rows[0].groups) for r in rows) and len(rows) == 2
    assert M.align(df.limit(0), "id").count() == 0
