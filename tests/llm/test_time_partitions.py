import calendar
import hashlib
import zlib
from datetime import datetime, timedelta
from pathlib import Path

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from verdigris.llm import time_partitions as M
from verdigris.llm.common import kept_path

from compare import SMALL

NAMES = ["click_id", "ts", "arrived_at", "client_id", "kind", "value", "props"]
SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"


def moment(row):
    ts, k = row[1], zlib.crc32(str(row[0]).encode()) % 128
    if ts is None:
        return None
    if k < 16:
        return ts - timedelta(days=(k + 6) ** 3)
    return datetime(ts.year, ts.month, ts.day) - timedelta(days=ts.weekday()) if k > 111 else ts


def runs(siblings, limit):
    """[first, last, rows, splits] of siblings (child, rows)."""
    out = []
    for child, rows in siblings:
        if len(rows) > limit:
            out.append([child, child, rows, True])
        elif out and not out[-1][3] and len(out[-1][2]) + len(rows) <= limit:
            out[-1][1] = child
            out[-1][2] = out[-1][2] + rows
        else:
            out.append([child, child, rows, False])
    return out


def brute_leaves(rows, limit):
    timed = [(moment(r), r) for r in rows]
    found = {"null": [r for m, r in timed if m is None]} if any(m is None for m, _ in timed) else {}
    timed = [x for x in timed if x[0] is not None]

    def split(path, depth, rows):
        if depth == 0:
            years = [m.year for m, _ in rows]
            children = range(min(years), max(years) + 1)
        else:
            children = {1: range(1, 13), 3: range(24)}.get(depth) or range(1, calendar.monthrange(int(path[0]), int(path[1]))[1] + 1)
        of = lambda m: (m.year, m.month, m.day, m.hour)[depth]
        held = {c: [] for c in children}
        for x in rows:
            held[of(x[0])].append(x)
        name = lambda c: f"{c:04d}" if depth == 0 else f"{c:02d}"
        for first, last, some, over in runs(held.items(), limit):
            if over and depth < 3:
                split([*path, name(first)], depth + 1, some)
            elif some:
                found["/".join([*path, f"{name(first)}-{name(last)}"])] = [r for _, r in some]

    if timed:
        split([], 0, timed)
    return found


def order(r):
    m = moment(r)
    return (m is not None, m or datetime.min, r[2] is not None, r[2] or datetime.min, r[0] is not None, r[0] or 0, repr(r[3:]))


def brute_files(rows, limit):
    out = {}
    for leaf, held in brute_leaves(rows, limit).items():
        held = sorted(held, key=order)
        for p in range(0, len(held), limit):
            out[leaf, p // limit + 1] = held[p : p + limit]
    return out


def want(rows):
    limit = 1 + len(rows) // 800
    cut = datetime(2024, 4, 1)
    known = lambda r: r[2] is not None and r[2] < cut
    before, after = brute_files([r for r in rows if known(r)], limit), brute_files(rows, limit)
    digest = lambda held: hashlib.sha256(",".join("" if r[0] is None else str(r[0]) for r in held).encode()).hexdigest()
    return sorted((leaf, part, digest(held), len(held), sum(not known(r) for r in held), before.get((leaf, part)) != held) for (leaf, part), held in after.items())


def check(got, rows):
    assert sorted((r.leaf, r.part, r.ids_sha256, r.n_rows, r.n_new, r.rewritten) for r in got) == want(rows)
    assert all(r.columns == ",".join(NAMES) for r in got)
    paths = [Path(r.path.removeprefix("file:")) for r in got]
    for path, r in zip(paths, got, strict=True):
        ids = pq.ParquetFile(path).read(["click_id"])["click_id"].to_pylist()
        assert hashlib.sha256(",".join("" if i is None else str(i) for i in ids).encode()).hexdigest() == r.ids_sha256
    assert not paths or set(paths[0].parent.parent.rglob("*.parquet")) == set(paths)


def test_query_against_brute_force(spark):
    rows = duckdb.sql(f"SELECT {','.join(NAMES)} FROM '{SMALL}/clicks.parquet'").fetchall()
    got = M.op12_time_partitions(spark, SMALL).collect()
    check(got, rows)
    assert {r.rewritten for r in got} == {True, False} and max(r.part for r in got) > 1


def write(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/clicks.parquet")
    return str(path)


def test_broken_rows(spark, tmp_path):
    """Nulls in every column, repeated rows, one hour and one row of very many, leap days and the year's last hour."""
    at = datetime(2024, 2, 29, 23, 59, 59, 999_999)
    rows = [(i, at + timedelta(hours=i), at + timedelta(days=i), None, None, None, None) for i in range(60)]
    rows += [(7, datetime(2024, 2, 29, 5), datetime(2024, 3, 1), 1, "click", 1.0, "{}")] * 40  # more than one part of equal rows
    rows += [(i, datetime(2024, 4, 1, 5, 0, i % 7), datetime(2024, 4, 1), 1, "a", None, None) for i in range(40)]
    rows += [(i, None, at if i % 2 else None, 1, "b", 2.0, "x" * i) for i in range(9)]
    rows += [(None, datetime(2023, 12, 31, 23), None, None, None, float("nan"), None), (5000, datetime(2024, 1, 1), None, 1, "c", -0.0, "")]
    got = M.op12_time_partitions(spark, write(spark, rows, tmp_path)).collect()
    check(got, rows)
    assert {r.leaf for r in got} >= {"null"} and sum(r.n_rows for r in got) == len(rows)


def test_empty_table(spark, tmp_path):
    assert M.op12_time_partitions(spark, write(spark, [], tmp_path)).count() == 0


def test_only_rows_without_a_moment(spark, tmp_path):
    rows = [(i, None, datetime(2024, 1, 1), None, None, None, None) for i in range(5)]
    got = M.op12_time_partitions(spark, write(spark, rows, tmp_path)).collect()
    check(got, rows)
    assert not any(r.rewritten for r in got)


@pytest.mark.parametrize(
    ("counts", "want"),
    [
        ([0, 3, 0, 7, 7, 11, 0, 2, 8, 0], [(0, 3, 10), (4, 4, 7), (5, 5, 11), (6, 9, 10)]),
        ([11, 11], [(0, 0, 11), (1, 1, 11)]),
        ([10, 0, 0, 1], [(0, 2, 10), (3, 3, 1)]),
        ([], []),
    ],
)
def test_fold_of_siblings(spark, counts, want):
    members = F.array(*[F.struct(F.lit(i).alias("child"), F.lit(n).cast("bigint").alias("n")) for i, n in enumerate(counts)]).cast("array<struct<child:int,n:bigint>>")
    got = spark.range(1).select(F.inline(M.runs_of(members, 10))).collect()
    assert [(r.first, r.last, r.n) for r in got] == want and all(r.over == (r.n > 10) for r in got)


def test_a_table_with_a_leaf_column(spark):
    df = spark.createDataFrame([(i, datetime(2024, 1, 1 + i), "x") for i in range(4)], "id long, leaf timestamp_ntz, part string")
    folder = kept_path(spark, "test-layout")
    assert M.rewrite(df, folder, F.col("leaf"), 2).count() == 0
    assert M.rewrite(df, folder, F.col("leaf"), 2).count() == 2
    files = M.file_rows(spark, folder, df.columns, "id", F.lit(True)).collect()
    assert sorted((r.leaf, r.n_rows, r.columns) for r in files) == [("2024/01/01-02", 2, "id,leaf,part"), ("2024/01/03-31", 2, "id,leaf,part")]


def test_leaves_by_a_shuffled_range_join(spark, monkeypatch):
    df = spark.createDataFrame([(i, datetime(2023 + i % 2, 1 + i % 12, 1 + i % 28, i % 24)) for i in range(200)], "id long, at timestamp_ntz")
    found = lambda: sorted((r.row.id, r.leaf, r.part) for r in M.placed(df, F.col("at"), 5).collect())
    want = found()
    monkeypatch.setattr(M, "BROADCAST_LEAVES", 0)
    assert found() == want and len(want) == 200
