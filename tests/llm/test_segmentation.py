import math
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from verdigris.llm import segmentation as M

from compare import SMALL

PIECES = M.pieces_of(M.default_model())


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=80))
def test_round_trip(text):
    assert PIECES.decode(M.sample_ids(PIECES, [text], [1])[0].tolist()) == text


def test_round_trip_of_odd_texts():
    for text in ("a▁b", "▁", "   lead", "trail   ", " " * 700, "x" * 3000, "\x00\U0010fffd", "𝔘𝔫" * 300, "中文\n\n\t x"):
        assert PIECES.decode(M.sample_ids(PIECES, [text], [1])[0].tolist()) == text


def every(word):
    """All segmentations and their weights."""
    if not word:
        return [((), 1.0)]
    out = []
    for j in range(1, len(word) + 1):
        hit = PIECES.of.get(word[:j])
        if hit:
            out += [((hit[0], *rest), math.exp(hit[1]) * w) for rest, w in every(word[j:])]
    return out


def test_shares_follow_the_weights():
    sharp = M.Pieces(M.default_model(), 0.2)
    ways = {}
    for ids, _ in every(" there"):
        ways[ids] = math.exp(sum(dict(sharp.of.values())[i] for i in ids))
    total, n = sum(ways.values()), 20_000
    seen = Counter(tuple(x.tolist()) for x in M.sample_ids(sharp, [" there"] * n, [M.row_key(i, 3) for i in range(n)]))
    assert set(seen) <= set(ways)
    for ids, w in ways.items():
        p = w / total
        assert abs(seen[ids] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3


def test_rows_do_not_depend_on_their_batch():
    texts = ["the first text here", "another one", "the first text here"]
    keys = [M.row_key(i, 9) for i in range(3)]
    together = M.sample_ids(PIECES, texts, keys)
    for t, k, want in zip(texts, keys, together, strict=True):
        assert M.sample_ids(PIECES, [t], [k])[0].tolist() == want.tolist()


def test_frames(spark):
    df = spark.createDataFrame([(1, "hello there", 5), (None, None, 6), (1, "hello there", 7), (2, "", 8)], "doc_id long, text string, ids int")
    ids = M.segment(df.drop("ids"))
    assert sorted((r.doc_id is None, r.text) for r in M.decode(ids).collect()) == sorted([(False, "hello there"), (True, ""), (False, "hello there"), (False, "")])
    assert len({tuple(r.ids) for r in M.segment(df).where("doc_id = 1").collect()}) == 1
    assert M.segment(df.limit(0)).count() == 0


def test_query_is_lossless(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("want"))
    out = M.op8_segmentation(spark, SMALL).join(docs, "doc_id")
    assert out.count() == docs.count() and out.where("want <> decoded_sha256").count() == 0
