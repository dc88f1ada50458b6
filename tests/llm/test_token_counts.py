import public_tokenizers
import pytest
from tokenizers import Tokenizer

from verdigris.llm import token_counts as M
from verdigris.llm.common import kept_path
from verdigris.llm.tokens import AGREED, ByteIds, encoder_of

from compare import SMALL

BYTES, WORDS, PIECES = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
ODD = ["", " ", "\n\n x  y\t", "a<|endoftext|>b <|endoftext|>", "naïve ﬁ 你好，世界 한국어 🎉🏽", "x" * 3000, "ա ՘ ₏ \U00011de0 1٩2", " 's'll 'S''d", "\r\n\r\n    　z", "<s></s><unk><0x41>▁"]


def cache(spark):
    return M.CountCache(spark, kept_path(spark, "test-counts"))


def test_query_against_the_library(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    library = Tokenizer.from_file(BYTES)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in M.op13_token_counts(spark, SMALL).collect()}
    want = {k: len(library.encode(t, add_special_tokens=False).ids) for k, t in docs.items()}
    assert got == {k: (len(docs[k].encode()), n, n > 1024) for k, n in want.items()}


@pytest.mark.parametrize("vocabulary", [BYTES, WORDS, PIECES])
def test_odd_texts(spark, vocabulary):
    rows = [(i, t) for i, t in enumerate([*ODD, None, ODD[4]])]
    got = M.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), cache(spark), vocabulary=vocabulary).collect()
    if vocabulary == PIECES:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        count = lambda t: len(model.encode(t))
    else:
        library = Tokenizer.from_file(vocabulary)
        count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    assert {r.doc_id: (r._n_bytes, r._n_tokens) for r in got} == {i: (len((t or "").encode()), count(t or "")) for i, t in rows}


def test_ids_with_and_without_specials():
    library = Tokenizer.from_file(BYTES)
    for specials in (True, False):
        library.encode_special_tokens = not specials
        own = ByteIds(BYTES, specials)
        for text in [*ODD, *ODD]:
            ids = own.ids_of(text)
            assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == library.encode(text, add_special_tokens=False).ids


def test_agreed_characters_split_alike():
    library, own = Tokenizer.from_file(BYTES).pre_tokenizer, ByteIds(BYTES)
    for low in range(0, 0x110000, 64):
        chars = [chr(c) for c in range(low, low + 64) if not 0xD800 <= c < 0xE000 and AGREED.fullmatch(chr(c))]
        text = "".join(f"a{c}1{c}!{c} " for c in chars)
        if chars:
            assert [text[a:b] for _, (a, b) in library.pre_tokenize_str(text)] == own.words.findall(text)


def test_only_distinct_misses_are_encoded(spark):
    held = cache(spark)
    version = M.tokenizer_version(BYTES)
    first = spark.createDataFrame([(1, "one two"), (2, "one two"), (3, None)], "doc_id long, text string")
    assert M.missing(first, held.stored(version)).count() == 2
    M.count_tokens(first, held)
    assert held.stored(version).count() == 2
    more = spark.createDataFrame([(4, "one two"), (5, "three")], "doc_id long, text string")
    assert [r.text for r in M.missing(more, held.stored(version)).collect()] == ["three"]
    assert {r.doc_id: r._n_tokens for r in M.count_tokens(more, held).collect()} == {4: 2, 5: 1}
    assert held.stored(version).count() == 3 == spark.read.parquet(held.folder).count()
    assert M.missing(more, held.stored(M.tokenizer_version(WORDS))).count() == 2  # another tokenizer has its own counts
    held.append(held.stored(version), version)  # as a batch that is appended twice
    assert {r.doc_id: r._n_tokens for r in M.count_tokens(more, held).collect()} == {4: 2, 5: 1}


def test_empty_tables_and_clashing_names(spark):
    df = spark.createDataFrame([("x", "one two", 1, 2, 3)], "id string, text string, digest int, row int, _n_tokens int")
    assert [tuple(r) for r in M.count_tokens(df, cache(spark)).select("id", "digest", "row", "_n_bytes", "_n_tokens").collect()] == [("x", 1, 2, 7, 2)]
    assert M.count_tokens(df.limit(0), cache(spark)).count() == 0


def test_one_encoder_for_a_worker():
    assert encoder_of(BYTES) is encoder_of(BYTES) is not encoder_of(BYTES, False)
