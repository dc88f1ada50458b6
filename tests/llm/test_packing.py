import random
import struct
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from verdigris.llm import packing as M
from verdigris.llm.tokens import word_ids

from compare import SMALL


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 99), max_size=60), st.integers(0, 5))
def test_evolve_packs_everything(lengths, seed):
    bins = M.evolve(lengths, 100, [(99, 1), (50, 50)], seed)
    assert Counter(x for b in bins for x in b) == Counter(lengths)
    assert all(sum(b) <= 100 for b in bins)
    assert len(bins) <= 2 * max(1, -(-sum(lengths) // 100))


def test_crossover_removes_what_is_there_twice():
    child = M.inject([(60, 40)], [[60, 30], [40, 40]], Counter([60, 40, 40, 30]), 100)
    assert Counter(x for b in child for x in b) == Counter([60, 40, 40, 30]) and [60, 40] in child


def test_evolution_beats_best_fit():
    rng = random.Random(2)
    lengths = [rng.choice([1400, 1500, 2000, 2100, 900, 1300]) for _ in range(2000)]
    assert len(M.evolve(lengths, 4096, [], 1)) < len(M.best_fit(sorted(lengths, reverse=True), [], 4096))


def test_ids_are_the_librarys():
    w = word_ids(M.default_vocabulary())
    for text in ("It's I'LL don't  x²½ ﬁ", "ſharp Ĳ ŉ İstanbul ÀÉ", "", " ", "<|endoftext|> a", "１２ 中文", "á ë", "× ÷ µ ª º", "ΑΣ", "“q” — … € ™ 12345 !!??##", "x y z", "\x0bA\x1cB", "naïve Straße GROẞ", "a\tb\r\nc", "😀 ok"):
        assert w.ids_of(text) == b"".join(struct.pack("<I", i) for i in w.whole.encode(text, add_special_tokens=False).ids), text


def test_pieces():
    ids = struct.pack("<9I", *range(9))
    assert [p[:3] for p in M.pieces_of(ids, 4)] == [(0, 0, 4), (1, 4, 4), (2, 8, 1)]
    assert M.pieces_of(ids, 4)[1][3] == zlib.crc32(ids[16:32])


@pytest.mark.parametrize("island", [20_000, 40])
def test_sequences_are_gapless(spark, island):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (None, "a"), (-3, "x " * 10_000), (-3, "x " * 10_000)], docs.schema))
    pieces = M.token_pieces(docs)
    rows = M.pack(pieces, island_rows=island).toPandas()
    assert len(rows) == pieces.count()
    total = 0
    for _, g in rows.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == (g.length.cumsum() - g.length).tolist() and g.length.sum() <= M.LENGTH
        total += g.length.sum()
    assert rows.sequence_id.nunique() <= -(-total // M.LENGTH) * 1.05 + 2
    assert sorted(rows[rows.doc_id == -3].piece.tolist()) == [0, 0, 1, 1, 2, 2]


def test_empty(spark):
    assert M.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_added_tokens_are_the_librarys():
    from tokenizers import Tokenizer

    w, plain = word_ids(M.default_vocabulary()), Tokenizer.from_file(M.default_vocabulary())
    assert list(struct.unpack("<3I", w.ids_of("hello <|endoftext|> world"))) == [3306, 49407, 1002]
    for text in ("hello <|endoftext|> world", "<|startoftext|>a", "a<|endoftext|><|ENDOFTEXT|> b", "<|EndOfText|>", "<| endoftext |>"):
        assert w.ids_of(text) == b"".join(struct.pack("<I", i) for i in plain.encode(text, add_special_tokens=False).ids), text


def exact(lengths, capacity):
    """The least number of bins, by trying every bin for each piece."""
    best = len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(order):
            best = len(rooms)
            return
        for room in {r for r in rooms if r >= order[i]}:
            place(i + 1, [*rooms[: rooms.index(room)], room - order[i], *rooms[rooms.index(room) + 1 :]])
        place(i + 1, [*rooms, capacity - order[i]])

    order = sorted(lengths, reverse=True)
    place(0, [])
    return best


def test_as_few_bins_as_an_exact_packing():
    rng = random.Random(4)
    over = 0
    for seed in range(40):
        lengths = [rng.randint(15, 70) for _ in range(rng.randint(1, 9))]
        over += len(M.evolve(lengths, 100, [], seed)) - exact(lengths, 100)
    assert over == 0


def test_generations_improve_on_their_first_pool():
    rng = random.Random(5)
    lengths = [rng.randrange(700, 2300) for _ in range(800)]
    pool = M.first_pool(lengths, 4096, random.Random(1), M.POPULATION)
    assert len(M.evolve(lengths, 4096, [], 1)) < min(map(len, pool))


def test_migrants_change_an_islands_bins():
    rng = random.Random(6)
    lengths = [rng.randrange(700, 2300) for _ in range(800)]
    other = M.best_patterns(M.evolve(lengths[:400] * 2, 4096, [], 9))
    alone, joined = M.evolve(lengths, 4096, [], 1), M.evolve(lengths, 4096, other, 1)
    shape = lambda bins: sorted(map(sorted, bins))
    assert shape(alone) != shape(joined) and Counter(sum(joined, [])) == Counter(lengths)


def test_clashing_names(spark):
    df = spark.createDataFrame([(i, 1000 + i, 5, 1, 2, 3, 4, 6) for i in range(9)], "doc_id long, length long, ids_crc32 long, island int, fill int, _number int, sequence_id int, row int")
    rows = M.pack(df, island_rows=4).collect()
    assert sorted((r.doc_id, r.island, r.fill, r._number, r.row) for r in rows) == [(i, 1, 2, 3, 6) for i in range(9)]
    assert len({r.sequence_id for r in rows}) in (3, 4)
