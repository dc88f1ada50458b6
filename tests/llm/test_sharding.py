from collections import Counter

import pytest

from verdigris.llm import sharding as M


def test_shares_are_even_and_moves_are_few():
    names = [f"s{i}" for i in range(7)]
    before, after = M.lookup_table(names, 1009), M.lookup_table(names[:-1], 1009)
    assert set(Counter(before).values()) <= {144, 145}
    moved = sum(a != b for a, b in zip(before, after, strict=True) if a != 6)
    assert moved < 0.15 * 1009


def test_table_follows_preferences():
    """A slower filling, slot by slot, gives the same table."""
    names, slots = ["a", "b", "c"], 13
    owner, turns = {}, [0, 0, 0]
    orders = [[(o + j * s) % slots for j in range(slots)] for o, s in (M.preference(n, slots) for n in names)]
    while len(owner) < slots:
        for i in range(3):
            while len(owner) < slots and orders[i][turns[i]] in owner:
                turns[i] += 1
            if len(owner) < slots:
                owner[orders[i][turns[i]]] = i
    assert M.lookup_table(names, slots) == [owner[s] for s in range(slots)]


def test_bad_input():
    for names, slots in ((["a"], 12), ([], 13), (["a", "a"], 13), ([str(i) for i in range(14)], 13)):
        with pytest.raises(ValueError):
            M.lookup_table(names, slots)


def test_place(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (None, "y"), (2, None)], "doc_id long, shard string")
    rows = M.place(df, "doc_id", ["p", "q"], 13).collect()
    assert len(rows) == 4 and {r.shard for r in rows} <= {"p", "q"} and len({r.slot for r in rows if r.doc_id == 1}) == 1
    assert M.place(df.limit(0), "doc_id").count() == 0
    plan = M.place(df, "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_hot_source_spreads(spark):
    df = spark.range(20_000).selectExpr("id as doc_id", "'hot' as source")
    counts = [r["count"] for r in M.place(df, "doc_id", ["p", "q", "r", "s"], 251).groupBy("shard").count().collect()]
    assert len(counts) == 4 and max(counts) < 1.1 * min(counts)


def test_placed_rows_against_brute_force(spark):
    """Every document's slot by its id's MD5, and the shard that a slower filling of the table gives the slot."""
    import hashlib

    from compare import SMALL

    owner, free = [None] * M.SLOTS, M.SLOTS
    places = [M.preference(s, M.SLOTS) for s in M.SHARDS]
    turn = [0] * len(places)
    while free:
        for i, (offset, skip) in enumerate(places):
            while free and owner[(offset + turn[i] * skip) % M.SLOTS] is not None:
                turn[i] += 1
            if free:
                owner[(offset + turn[i] * skip) % M.SLOTS] = M.SHARDS[i]
                free -= 1
    docs = [(r.doc_id, r.source) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    slot = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16) % M.SLOTS
    got = sorted((r.doc_id, r.source, r.slot, r.shard) for r in M.op4_sharding(spark, SMALL).collect())
    assert got == sorted((i, s, slot(i), owner[slot(i)]) for i, s in docs)
