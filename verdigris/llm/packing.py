"""Packing of token sequences by a grouping genetic algorithm on islands.

Documents are tokenised, closed with an end id and cut only if longer than a
sequence. Pieces that fill a sequence stand alone; the others are dealt by hash
into islands of a bounded size. On an island an individual is a set of bins, first
made by best fit in a random order of its own. Crossover injects whole well-filled
bins of one parent into the other, removes the bins that hold the same pieces
again, and places the displaced pieces by best fit; mutation opens the emptiest
bins. Pieces of one length are interchangeable, so bins are handled as patterns of
lengths. Every island sends the best patterns of its first epoch to the next island
in a ring, which injects them into its own individuals at the start of its second.
Poorly filled bins are then opened and their pieces packed again, on ever fewer
islands. The lower bound is looked at after a generation, never before.
"""

from __future__ import annotations

import random
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import boxed, pieces_by_bytes, released, table, unboxed, whole, written
from .tokens import word_ids

LENGTH = 4096
END_ID = 1
#: Pieces on an island.
ISLAND = 20_000
POPULATION = 6
#: Children of an epoch, unless the lower bound is reached; CALM of them without a better one end it as well.
GENERATIONS = 40
CALM = 12
#: Bins filled at least so much of the donor's fullest one are well filled; crossover injects this share of them.
WELL_FILLED = 0.98
INJECTED = 0.8
#: Share of the emptiest bins that a mutation opens.
OPENED = 0.1
#: Patterns that an island sends on.
ELITES = 64
#: Bins filled less than this are opened for the next round.
OPEN_BELOW = 0.95
ROUNDS = 3
#: Text that is tokenised before its pieces leave a Python worker.
SLICE_BYTES = 4 << 20

_PIECE = "piece int, start bigint, length bigint, ids_crc32 bigint"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces_of(ids: bytes, length: int = LENGTH) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of the ids, which are 4 bytes each."""
    step = 4 * length
    return [(i, at // 4, len(ids[at : at + step]) // 4, zlib.crc32(ids[at : at + step])) for i, at in enumerate(range(0, len(ids), step))]


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32): every document has one piece at least; null texts count as empty."""
    ship(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    end = end_id.to_bytes(4, "little")
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(path)
        for batch in (x for whole_batch in batches for x in pieces_by_bytes(whole_batch, 1, SLICE_BYTES)):
            at, rows = [], []
            for own, text in enumerate(batch.column(1).to_pylist()):
                for row in pieces_of(encoder.ids_of(text) + end, length):
                    at.append(own)
                    rows.append(row)
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], [id_col, "piece", "start", "length", "ids_crc32"])
        encoder.forget()
        released()

    return docs.select(id_col, whole(F.col(text_col)).alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, {_PIECE}")


def best_fit(lengths: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Puts each length, in the given order, into the fullest bin with room for it, or a new one. Changes bins."""
    by_room: dict[int, list[int]] = {}
    mask = 0
    for i, b in enumerate(bins):
        room = capacity - sum(b)
        by_room.setdefault(room, []).append(i)
        mask |= 1 << room
    for n in lengths:
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                mask &= ~(1 << room)
            bins[at].append(n)
            room -= n
        else:
            at, room = len(bins), capacity - n
            bins.append([n])
        by_room.setdefault(room, []).append(at)
        mask |= 1 << room
    return bins


def inject(patterns: list[tuple[int, ...]], parent: list[list[int]], counts: Counter, capacity: int) -> list[list[int]]:
    """The patterns as whole bins, then the parent's bins whose pieces are all left; displaced pieces go by best fit."""
    left = Counter(counts)

    def take(lengths) -> bool:
        need = Counter(lengths)
        if any(left[n] < k for n, k in need.items()):
            return False
        left.subtract(need)
        return True

    child = [list(p) for p in patterns if take(p)]
    child += [list(b) for b in parent if take(b)]
    return best_fit(sorted((+left).elements(), reverse=True), child, capacity)


def fitness(bins: list[list[int]], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones: the mean of squared fill."""
    return -len(bins), sum((sum(b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def first_pool(lengths: list[int], capacity: int, rng: random.Random, population: int) -> list[list[list[int]]]:
    """Individuals by best fit: one with long pieces first, each other in a random order of its own that leans that way."""
    return [best_fit(sorted(lengths, key=lambda n, low=0.6 if i else 1.0: n * rng.uniform(low, 1.0), reverse=True), [], capacity) for i in range(population)]


def crossed(donor: list[list[int]], parent: list[list[int]], counts: Counter, capacity: int, rng: random.Random) -> list[list[int]]:
    """Well-filled bins of the donor injected into the parent; in one of two children the emptiest bins are opened first."""
    least = WELL_FILLED * max(map(sum, donor))
    chosen = [tuple(b) for b in donor if sum(b) >= least and rng.random() < INJECTED]
    kept = sorted(parent, key=sum, reverse=True)
    if rng.random() < 0.5:
        kept = kept[: len(kept) - max(1, int(OPENED * len(kept)))]
    return inject(chosen, kept, counts, capacity)


def epoch(pool: list[list[list[int]]], counts: Counter, capacity: int, rng: random.Random, generations: int = GENERATIONS) -> list[list[list[int]]]:
    """The pool after generations of one child each, which replaces the worst if it is better; the best stands first."""
    rated = sorted(((fitness(b, capacity), i, b) for i, b in enumerate(pool)), reverse=True)
    bound, calm, made = -(-sum(n * k for n, k in counts.items()) // capacity), 0, len(pool)
    for _ in range(generations if len(pool) > 1 else 0):
        donor, parent = rng.sample(rated[: max(2, (len(rated) + 1) // 2)], 2)
        child = crossed(donor[2], parent[2], counts, capacity, rng)
        value, best = fitness(child, capacity), rated[0][0]
        if value > rated[-1][0]:
            made += 1
            rated[-1] = (value, made, child)
            rated.sort(reverse=True)
        calm = 0 if value > best else calm + 1
        if len(rated[0][2]) <= bound or calm >= CALM:
            break
    return [x[2] for x in rated]


def evolve(lengths: list[int], capacity: int, migrants: list[tuple[int, ...]], seed: int, population: int = POPULATION, generations: int = GENERATIONS) -> list[list[int]]:
    """Two epochs; migrants, patterns of another island's first one, are injected between them. An island alone takes its own."""
    if not lengths:
        return []
    rng, counts = random.Random(seed), Counter(lengths)
    pool = epoch(first_pool(lengths, capacity, rng, population), counts, capacity, rng, generations)
    pool = pool[: max(1, population - 1)] + [inject(migrants or best_patterns(pool[0]), pool[-1], counts, capacity)]
    return epoch(pool, counts, capacity, rng, generations)[0]


def best_patterns(bins: list[list[int]]) -> list[tuple[int, ...]]:
    return sorted({tuple(sorted(b, reverse=True)) for b in bins}, key=lambda b: (-sum(b), len(b), b))[:ELITES]


def _elites(group: pa.Table, length: int, island: int, islands: int) -> pa.Table:
    """The best patterns of the island's first epoch, for the next island."""
    lengths = sorted(group.column("length").to_pylist())
    rng, counts = random.Random(island), Counter(lengths)
    best = best_patterns(epoch(first_pool(lengths, length, rng, POPULATION), counts, length, rng)[0])
    return pa.table({"island": pa.array([(island + 1) % islands], pa.int64()), "patterns": pa.array([[list(p) for p in best]], pa.list_(pa.list_(pa.int64())))})


def _settle(group: pa.Table, migrants: list[tuple[int, ...]], length: int, island: int, level: int, names: list[str]) -> pa.Table:
    """The rows with their place."""
    group = group.take(pa.compute.sort_indices(group, sort_keys=[("length", "descending"), ("_crc", "ascending")]))
    lengths = group.column("length").to_pylist()
    rows: dict[int, list[int]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        rows.setdefault(lengths[i], []).append(i)
    sequence, offset, fill = [0] * len(lengths), [0] * len(lengths), [0] * len(lengths)
    for number, b in enumerate(evolve(sorted(lengths), length, migrants, island)):
        at, total = 0, sum(b)
        for n in sorted(b, reverse=True):
            i = rows[n].pop()
            sequence[i], offset[i], fill[i] = (level << 58) | (island << 24) | number, at, total
            at += n
    return pa.table([*(group.column(c) for c in names), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64()), pa.array(fill, pa.int64())], names=[*names, "sequence_id", "offset", "fill"])


def _sender(length: int, islands: int):
    return lambda key, group: _elites(group, length, key[0].as_py(), islands)


def _settler(level: int, length: int, names: list[str]):
    """For an island alone, and for one with the patterns that migrate to it."""

    def alone(key, group):
        return _settle(group, [], length, key[0].as_py(), level, names)

    def joined(key, group, sent):
        patterns = [tuple(p) for x in sent.column("patterns").to_pylist() for p in x] if sent.num_rows else []
        return _settle(group, patterns, length, key[0].as_py(), level, names)

    return alone, joined


def pack(pieces: DataFrame, *, length: int = LENGTH, island_rows: int = ISLAND, open_below: float = OPEN_BELOW, rounds: int = ROUNDS) -> DataFrame:
    """pieces with sequence_id and offset (columns of these names are replaced); needs length, ids_crc32 and any other columns.

    Sequences hold at most length tokens, gapless from offset 0. Rows are told
    apart by place alone, so equal rows may repeat; other columns, whatever their
    names, pass through. A frame without rows gives none. island_rows bounds what a
    task holds; it must be under 2^24.
    """
    spark = pieces.sparkSession
    ship(spark)
    own = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    slim = pieces.select(boxed(pieces, "sequence_id", "offset"), F.col("length").cast("bigint").alias("length"), F.col("ids_crc32").cast("bigint").alias("_crc"))
    # a number for each row, once: the rows themselves stay in this table, and only numbers and lengths are packed
    source = written(slim.withColumn("_number", F.monotonically_increasing_id()), "pack-pieces")
    names = ["_number", "length", "_crc"]
    shape = "_number bigint, length bigint, _crc bigint"
    full = source.where(F.col("length") >= length).select("_number", (F.lit(1 << 62) + F.col("_number")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    done = [full]
    rest = source.where(F.col("length") < length).select(*names)
    for level in range(rounds):
        n = rest.count()
        if not n:
            break
        islands = -(-n // island_rows)
        dealt = rest.select(*names, F.pmod(F.xxhash64(F.lit(level), "_number"), F.lit(islands)).alias("island"))
        last = islands == 1 or level == rounds - 1

        out_shape = f"{shape}, sequence_id bigint, offset bigint, fill bigint"
        if islands == 1:
            settled = dealt.groupBy("island").applyInArrow(_settler(level, length, names)[0], out_shape)
        else:
            elites = written(dealt.select("length", "island").groupBy("island").applyInArrow(_sender(length, islands), "island bigint, patterns array<array<bigint>>"), "pack-elites")
            settled = dealt.groupBy("island").cogroup(elites.groupBy("island")).applyInArrow(_settler(level, length, names)[1], out_shape)
        settled = written(settled, "pack-round")
        if last:
            done.append(settled.select("_number", "sequence_id", "offset"))
            break
        done.append(settled.where(F.col("fill") >= open_below * length).select("_number", "sequence_id", "offset"))
        rest = settled.where(F.col("fill") < open_below * length).select(*names)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return source.select("row", "_number").join(out, "_number").select(*unboxed(own), "sequence_id", "offset")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str | None = None, length: int = LENGTH) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, sequence_id, offset) of every document. Other columns don't matter; repeated rows stay."""
    return pack(token_pieces(docs, id_col, text_col, vocabulary=vocabulary, length=length), length=length)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of 4,096: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text has one piece, its end id; repeated rows are packed each;
    an empty table gives none.
    """
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
