"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

Equal texts collapse by digest first. A text is the bag of its five-word shingles,
weighted by frequency times inverse document frequency, ln(1 + n / df). Document
frequencies are exact sums over all distinct texts: each task adds up what it holds,
the sums meet by ranges of the hash. Copies are no evidence that a passage is
common: a text weighs one over the size of its group, which is one plus the mean,
over LEAST_HASHES independent least shingle hashes, of the other texts that share
it; that mean is the sum of the text's Jaccard similarities to all others, up to
the error of so many samples. A df under one COMMON-th of all shingles counts as
that share: so few shingles lie above it, whatever the data, that they are broadcast.

Each of BANDS x ROWS samples is, for a pair of texts, equal with probability their
weighted Jaccard similarity. Texts that agree in all samples of a band share a
bucket. Buckets link to their least member, and the components of these links are
families; a family is verified in one task, whole texts at hand, each text shipped
once. Families beyond FAMILY texts are verified bucket by bucket, and a bucket
beyond that in chunks, each with the same PIVOTS members of the bucket, which
connects most of it; what stays apart meets the whole bucket, a pair of chunks at
a time. Verified links (weighted Jaccard similarity of THRESHOLD or more) give the
classes; pairs that are connected already need no check.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import distinct_texts, mixed, numbered, pieces_by_bytes, released, sums_by_key, table, text_digest, whole, word_hashes, written
from .components import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 12, 3
SAMPLES = BANDS * ROWS
#: Equal samples of a pair under which it can't reach the threshold (by chance: 1 in 10 million).
LEAST_EQUAL = 15
LEAST_HASHES = 16
#: At most so many shingles can have a df of over one COMMON-th of all shingles: 12 bytes each, 50 MB.
COMMON = 1 << 22
#: Shingles that a task adds up before they leave it, and bytes of text for each range of hashes.
SUMMED = 2_000_000
RANGE_BYTES = 16 << 20
#: Bits of a shingle's hash that tell it from others where they are counted.
KEY_BITS = 48
#: Texts of a family that are verified in one task; a text counts once more for every WEIGHT bytes.
FAMILY = 2_000
WEIGHT = 16 << 10
SLICE_BYTES = 4 << 20
PIVOTS = 16
GROUP_BYTES = 4 << 20

_U = np.uint64
_rng = np.random.default_rng(7)
_STEP = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | _U(1)
_SEED = _rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64)
_mix = mixed


def shingles(text: str) -> np.ndarray:
    """64-bit hashes of the shingles, in text order. Fewer words than a shingle make one; no word, none."""
    words = word_hashes(text.encode())
    if not len(words):
        return words
    if len(words) < SHINGLE:
        return _mix((words * _STEP[: len(words)]).sum(keepdims=True, dtype=np.uint64))
    n = len(words) - SHINGLE + 1
    total = words[:n] * _STEP[0]
    for i in range(1, SHINGLE):
        total += words[i : i + n] * _STEP[i]
    return _mix(total)


class Frequencies:
    """Document frequencies of the shingles whose df is over floor, by the upper KEY_BITS of their hash; all others count as floor."""

    def __init__(self, keys: np.ndarray, df: np.ndarray, floor: float = 1.0):
        self.keys, self.df, self.floor = keys, df, floor


class Idf:
    """Weights of shingles."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, rest: float):
        self.keys, self.weights, self.rest = keys, weights, rest

    def of(self, e: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(e), self.rest)
        key = e >> _U(64 - KEY_BITS)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.weights[at], self.rest)


#: All shingles weigh the same.
FLAT = Idf(np.zeros(0, np.uint64), np.zeros(0), 1.0)


def bag(text: str, idf: Idf) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, ascending, and their weights."""
    e, n = np.unique(shingles(text), return_counts=True)
    return e, n * idf.of(e)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the lesser weights over sum of the greater ones; 0 without shingles."""
    total = a[1].sum() + b[1].sum()
    if not total:
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / (total - both))


def samples(e: np.ndarray, w: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """SAMPLES 32-bit samples for each segment of (e, w), which begin at starts and aren't empty."""
    sizes = np.diff(np.append(starts, len(e)))
    lw = np.log(w).astype(np.float32)
    out = np.empty((len(starts), SAMPLES), np.int32)
    segment = np.repeat(np.arange(len(starts)), sizes)
    scale = np.float32(2.0**-32)
    for k in range(SAMPLES):
        x = _mix(e ^ _SEED[k])
        y = _mix(x + _SEED[k])
        u = lambda v: (v.astype(np.float32) + np.float32(0.5)) * scale
        r = -np.log(u(x & _U(0xFFFFFFFF)) * u(x >> _U(32)))
        c = -np.log(u(y & _U(0xFFFFFFFF)) * u(y >> _U(32)))
        beta = ((x * _U(0x9E3779B97F4A7C15)) >> _U(40)).astype(np.float32) * np.float32(2.0**-24)
        t = np.floor(lw / r + beta)
        a = np.log(c) - r * (t - beta) - r
        least = np.minimum.reduceat(a, starts)
        hit = np.flatnonzero(a == least[segment])
        first = hit[np.concatenate(([True], segment[hit][1:] != segment[hit][:-1]))]
        out[:, k] = (_mix(e[first] + t[first].astype(np.int64).astype(np.uint64) * _U(0x9E3779B97F4A7C15)) >> _U(32)).astype(np.uint32).view(np.int32)
    return out


def band_hashes(sig: np.ndarray) -> np.ndarray:
    s = sig.view(np.uint32).astype(np.uint64).reshape(len(sig), BANDS, ROWS)
    h = np.zeros((len(sig), BANDS), np.uint64)
    for i in range(ROWS):
        h = _mix(h * _U(0x9E3779B97F4A7C15) + s[:, :, i] + _U(i + 1))
    return (h ^ (np.arange(BANDS, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))).view(np.int64)


def least_hashes(e: np.ndarray, seed: int = 0) -> np.ndarray:
    """LEAST_HASHES least values of hashes of the shingles, of which there is one at least."""
    salts = np.random.default_rng([11, seed]).integers(1, 1 << 63, LEAST_HASHES, dtype=np.uint64)
    return np.array([_mix(e ^ x).min() for x in salts], np.uint64).view(np.int64)


def _group_shares(texts: DataFrame, seed: int) -> tuple[DataFrame, int, int]:
    """(_t, share) of the distinct texts whose group has others, the number of rows, and of all rows' shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for y in batches for x in pieces_by_bytes(y, "_text", SLICE_BYTES)):
            found = [shingles(t) for t in batch.column("_text").to_pylist()]
            least = [least_hashes(e, seed).tolist() if len(e) else [] for e in found]
            yield pa.RecordBatch.from_arrays([batch.column("_t"), pa.array(least, pa.list_(pa.int64())), pa.array([len(e) for e in found], pa.int64())], ["_t", "least", "size"])
        released()

    rows = written(texts.select("_t", "_text").mapInArrow(run, "_t binary, least array<bigint>, size bigint"), "near-least")
    n, size = rows.agg(F.count(F.lit(1)), F.sum("size")).first()
    each = rows.groupBy("_t").agg(F.first("least").alias("least")).select("_t", F.posexplode("least").alias("k", "h"))
    shared = each.groupBy("k", "h").agg((F.count(F.lit(1)) - 1).alias("others")).where("others > 0")
    shares = each.join(shared, ["k", "h"]).groupBy("_t").agg((1 / (1 + F.sum("others") / LEAST_HASHES)).alias("share"))
    return shares, n, size or 0


_KEY_BYTES = KEY_BITS // 8


def _packed(keys: np.ndarray) -> bytes:
    """Ascending keys by bytes of one rank, which compress."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_KEY_BYTES].T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // _KEY_BYTES, 8), np.uint8)
    out[:, :_KEY_BYTES] = np.frombuffer(data, np.uint8).reshape(_KEY_BYTES, -1).T
    return out.view("<u8").ravel()


def document_frequencies(texts: DataFrame, seed: int = 0) -> tuple[Frequencies, int]:
    """Frequencies over the distinct texts of _text, each weighing one over the size of its group, and the number of rows."""
    texts = texts.select(F.unhex(F.md5("_text")).alias("_t"), "_text")
    shares, n, size = _group_shares(texts, seed)
    floor = max(1.0, size / COMMON)
    n_bytes = texts.agg(F.sum(F.octet_length("_text").cast("bigint"))).first()[0] or 0
    bits = max(0, (n_bytes // RANGE_BYTES).bit_length())
    distinct = texts.groupBy("_t").agg(F.first("_text").alias("_text")).join(shares, "_t", "left")

    def flushed(held: list[tuple[np.ndarray, float]]) -> pa.RecordBatch:
        keys, sums = sums_by_key(np.concatenate([k for k, _ in held]), np.repeat([x for _, x in held], [len(k) for k, _ in held]))
        cuts = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << _U(KEY_BITS - bits)).tolist() + [len(keys)]
        spans = [(i, a, b) for i, (a, b) in enumerate(itertools.pairwise(cuts)) if b > a]
        return pa.RecordBatch.from_arrays(
            [pa.array([i for i, _, _ in spans], pa.int32()), pa.array([_packed(keys[a:b]) for _, a, b in spans], pa.binary()), pa.array([sums[a:b].astype("<f8").tobytes() for _, a, b in spans], pa.binary())],
            ["part", "keys", "sums"],
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in (x for y in batches for x in pieces_by_bytes(y, "_text", SLICE_BYTES)):
            for text, share in zip(batch.column("_text").to_pylist(), batch.column("share").to_pylist(), strict=True):
                keys = np.unique(shingles(text) >> _U(64 - KEY_BITS))
                if len(keys):
                    held.append((keys, 1.0 if share is None else share))
                    total += len(keys)
                if total >= SUMMED:
                    yield flushed(held)
                    held, total = [], 0
        if held:
            yield flushed(held)
        released()

    def both(group: pa.Table) -> pa.Table:
        keys = np.concatenate([_unpacked(x) for x in group.column("keys").to_pylist()])
        keys, df = sums_by_key(keys, np.concatenate([np.frombuffer(x, "<f8") for x in group.column("sums").to_pylist()]))
        some = df > floor
        return pa.table({"part": group.column("part")[:1], "keys": pa.array([keys[some].tobytes()], pa.binary()), "sums": pa.array([df[some].tobytes()], pa.binary())})

    shape = "part int, keys binary, sums binary"
    rows = distinct.select("_text", "share").mapInArrow(count, shape).groupBy("part").applyInArrow(both, shape).orderBy("part").collect()
    if not rows:
        return Frequencies(np.zeros(0, np.uint64), np.zeros(0), floor), n
    return Frequencies(np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in rows]), np.concatenate([np.frombuffer(r["sums"], np.float64) for r in rows]), floor), n


def inverse_frequencies(frequencies: Frequencies, n: int) -> Idf:
    """ln(1 + n / df)."""
    n = max(n, 1)
    return Idf(frequencies.keys, np.log1p(n / frequencies.df).astype(np.float32), float(np.log1p(n / frequencies.floor)))


def _sign(batches: Iterator[pa.RecordBatch], idf: Idf) -> Iterator[pa.RecordBatch]:
    for batch in (x for y in batches for x in pieces_by_bytes(y, "_text", SLICE_BYTES)):
        texts, at = batch.column("_text").to_pylist(), 0
        while at < len(texts):
            bags, low, size = [], at, 0
            while at < len(texts) and size < 100_000:
                bags.append(bag(texts[at], idf))
                size += len(bags[-1][0])
                at += 1
            full = [i for i, b in enumerate(bags) if len(b[0])]
            sig = np.zeros((len(bags), SAMPLES), np.int32)
            if full:
                starts = np.cumsum([0, *(len(bags[i][0]) for i in full[:-1])])
                sig[full] = samples(np.concatenate([bags[i][0] for i in full]), np.concatenate([bags[i][1] for i in full]), starts)
            bands = band_hashes(sig)
            some = set(full)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_t").slice(low, len(bags)),
                    pa.array([r.tobytes() for r in sig], pa.binary()),
                    pa.array([b.tolist() if i in some else [] for i, b in enumerate(bands)], pa.list_(pa.int64())),
                    pa.array([1 + len(x) // WEIGHT for x in texts[low:at]], pa.int64()),
                ],
                ["_t", "sig", "bands", "weight"],
            )
    released()


def links_of(texts: list[str], sigs: list[bytes], idf: Idf, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Verified links that connect all that links connect: a pair that is connected already is passed over."""
    m = len(texts)
    sig = np.frombuffer(b"".join(sigs), np.int32).reshape(m, SAMPLES)
    bags: list = [None] * m
    parent = list(range(m))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def of(i: int):
        if bags[i] is None:
            bags[i] = bag(texts[i], idf)
        return bags[i]

    out = []
    for i in range(m - 1):
        near = np.flatnonzero((sig[i + 1 :] == sig[i]).sum(axis=1) >= LEAST_EQUAL) + i + 1
        for j in near.tolist():
            if root(i) != root(j) and weighted_jaccard(of(i), of(j)) >= threshold:
                parent[root(j)] = root(i)
                out.append((i, j))
    return out


def links_across(texts: list[str], sigs: list[bytes], roots: list[bytes], sides: list[int], band: int, idf: Idf, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Verified links that connect texts of different roots and sides, or of side -1; pairs that share an earlier band are left to it."""
    m = len(texts)
    sig = np.frombuffer(b"".join(sigs), np.int32).reshape(m, SAMPLES)
    number: dict[bytes, int] = {}
    parent = [number.setdefault(r, i) for i, r in enumerate(roots)]
    first, side = np.array(parent), np.array(sides)
    bags: list = [None] * m

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def of(i: int):
        if bags[i] is None:
            bags[i] = bag(texts[i], idf)
        return bags[i]

    out = []
    for i in range(m - 1):
        apart = np.flatnonzero((first[i + 1 :] != first[i]) & ((side[i + 1 :] != side[i]) | (side[i] < 0))) + i + 1
        equal = sig[apart] == sig[i]
        earlier = equal[:, : band * ROWS].reshape(len(apart), band, ROWS).all(axis=2).any(axis=1)
        for j in apart[(equal.sum(axis=1) >= LEAST_EQUAL) & ~earlier].tolist():
            if root(i) != root(j) and weighted_jaccard(of(i), of(j)) >= threshold:
                parent[root(j)] = root(i)
                out.append((i, j))
    return out


def _verify_across(idf: Idf, threshold: float):
    def run(group):
        group = group.sort_by([("unit", "ascending"), ("_t", "ascending")])
        units, ids, bands = (group.column(c).to_pylist() for c in ("unit", "_t", "band"))
        columns = [group.column(c).to_pylist() for c in ("_text", "sig", "root", "side")]
        us, vs, low = [], [], 0
        for i in range(1, len(units) + 1):
            if i == len(units) or units[i] != units[low]:
                for a, b in links_across(*(c[low:i] for c in columns), bands[low], idf, threshold):
                    us.append(ids[low + a])
                    vs.append(ids[low + b])
                low = i
        return pa.table({"u": pa.array(us, pa.binary()), "v": pa.array(vs, pa.binary())})

    return run


def _units_across(large: DataFrame, roots: DataFrame, family: int) -> DataFrame:
    """(_t, root, band, side, unit) of all pairs of large buckets (_t, band, h, weight) whose texts have different roots (node, root).

    A bucket's largest root is not compared with itself. The other texts, in chunks,
    meet one another and the chunks of the largest; a unit holds two chunks, about
    family texts, and a pair of chunks is in one unit.
    """
    known = large.join(roots.withColumnRenamed("node", "_t"), "_t", "left").withColumn("root", F.coalesce("root", "_t"))
    known = written(known.select("_t", "band", "h", "root", "weight"), "near-large")
    counts = known.groupBy("band", "h", "root").agg(F.sum("weight").alias("k"))
    heads = counts.groupBy("band", "h").agg(F.max(F.struct("k", "root")).alias("m"), F.sum("k").alias("n")).where("m.k < n")
    part = max(1, family // 2)
    chunks = lambda n: F.ceil(n / part).cast("int")
    heads = heads.select("band", "h", F.col("m.root").alias("head"), chunks(F.col("m.k")).alias("n_head"), chunks(F.col("n") - F.col("m.k")).alias("n_rest"))
    dealt = known.join(heads, ["band", "h"])  # at most one row for a weight of family in a band; AQE takes a shuffled join where that is much
    in_head = F.col("root") == F.col("head")
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("_t"), F.when(in_head, F.col("n_head")).otherwise(F.col("n_rest"))).cast("int"))
    own = F.col("chunk")
    unit = lambda kind, low, high, side: F.struct(F.lit(kind).alias("kind"), low.alias("low"), high.alias("high"), side.alias("side"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    with_rest = F.transform(upto("n_rest"), lambda x: unit(0, F.least(own, x), F.greatest(own, x), F.when(own == x, -1).when(own < x, 0).otherwise(1)))
    with_head = F.transform(upto("n_head"), lambda x: unit(1, own, x, F.lit(0)))
    of_head = F.transform(upto("n_rest"), lambda x: unit(1, x, own, F.lit(1)))
    met = dealt.select("_t", "root", "band", "h", F.inline(F.when(in_head, of_head).otherwise(F.concat(with_rest, with_head))))
    return met.select("_t", "root", "band", "side", F.xxhash64("band", "h", "kind", "low", "high").alias("unit"))


def _verify(idf: Idf, threshold: float):
    def run(group):
        group = group.sort_by([("unit", "ascending"), ("_t", "ascending")])
        units, ids = group.column("unit").to_pylist(), group.column("_t").to_pylist()
        texts, sigs = group.column("_text").to_pylist(), group.column("sig").to_pylist()
        us, vs, low = [], [], 0
        for i in range(1, len(units) + 1):
            if i == len(units) or units[i] != units[low]:
                for a, b in links_of(texts[low:i], sigs[low:i], idf, threshold):
                    us.append(ids[low + a])
                    vs.append(ids[low + b])
                low = i
        return pa.table({"u": pa.array(us, pa.binary()), "v": pa.array(vs, pa.binary())})

    return run


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = THRESHOLD, family: int = FAMILY, seed: int = 0) -> DataFrame:
    """(_t, root): the class of every distinct text that has a near duplicate; root is the least digest in it. seed is that of the group sizes' hashes."""
    ship(docs.sparkSession)
    texts = docs.select(text_digest(text_col).alias("_t"), whole(F.col(text_col)).alias("_text"))
    idf = inverse_frequencies(*document_frequencies(texts, seed))
    signed = texts.mapInArrow(lambda it: _sign(it, idf), "_t binary, sig binary, bands array<bigint>, weight bigint")
    signed = written(signed.groupBy("_t").agg(F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.first("weight").alias("weight")), "near-samples")
    bands = signed.select("_t", "weight", F.posexplode("bands").alias("band", "h"))
    buckets = bands.groupBy("band", "h").agg(F.min("_t").alias("least"), F.count(F.lit(1)).alias("n"), F.sum("weight").alias("size")).where("n > 1")
    members = written(bands.join(buckets, ["band", "h"]), "near-buckets")
    families = components(members.where(F.col("_t") != F.col("least")).select(F.col("_t").alias("u"), F.col("least").alias("v")).distinct())
    families = written(families, "near-families")
    weights = signed.select(F.col("_t").alias("node"), "weight")
    big = families.join(weights, "node").groupBy("root").agg(F.sum("weight").alias("k")).where(F.col("k") > family).select("root")
    small_units = families.join(big, "root", "left_anti").select(F.col("node").alias("_t"), F.xxhash64("root").alias("unit"))
    # large families: bucket by bucket, large buckets first in chunks that share their pivots
    in_big = members.join(families.join(big, "root", "left_semi").select(F.col("node").alias("_t")), "_t", "left_semi")
    chunks = F.ceil(F.col("size") / family).cast("int")
    dealt = in_big.select("_t", "band", "h", chunks.alias("chunks"), F.pmod(F.xxhash64("_t"), chunks).cast("int").alias("chunk"))
    by_hash = Window.partitionBy("band", "h").orderBy(F.xxhash64(F.lit("pivot"), "_t"), "_t")
    pivots = in_big.where(chunks > 1).select("_t", "band", "h", chunks.alias("chunks")).withColumn("rank", F.row_number().over(by_hash)).where(F.col("rank") <= PIVOTS)
    shared = pivots.select("_t", "band", "h", "chunks", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    big_units = dealt.unionByName(shared).select("_t", F.xxhash64("band", "h", "chunk").alias("unit")).distinct()
    units = written(small_units.unionByName(big_units), "near-units")
    needed = units.groupBy("_t").agg(F.collect_list("unit").alias("units"))
    held = texts.groupBy("_t").agg(F.first("_text").alias("_text")).join(needed, "_t").join(signed.select("_t", "sig"), "_t")
    held = written(held, "near-texts")
    size = held.agg(F.sum(F.octet_length("_text").cast("bigint") * F.size("units"))).first()[0] or 0
    groups = max(1, -(-size // GROUP_BYTES))
    placed = held.select("_t", "_text", "sig", F.explode("units").alias("unit"))
    links = placed.groupBy(F.pmod("unit", F.lit(groups)).alias("group")).applyInArrow(_verify(idf, threshold), "u binary, v binary")
    roots = components(written(links, "near-links"))
    large = in_big.where(F.col("size") > family).select("_t", "band", "h", "weight")
    if not large.isEmpty():
        across = written(_units_across(large, roots, family), "near-across")
        met = held.select("_t", "_text", "sig").join(across, "_t")
        size = met.agg(F.sum(F.octet_length("_text").cast("bigint"))).first()[0] or 0
        groups = max(1, -(-size // GROUP_BYTES))
        more = met.groupBy(F.pmod("unit", F.lit(groups)).alias("group")).applyInArrow(_verify_across(idf, threshold), "u binary, v binary")
        roots = components(written(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more), "near-all-links"))
    return roots.select(F.col("node").alias("_t"), "root")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = THRESHOLD) -> DataFrame:
    """Every row of docs with _class, the least id in its class, and _kept, true for one row of each class.

    Equal texts are one class, texts without words among them (null counts as
    empty). The row that stays has the least id; a null id comes last; of equal ids
    and texts, one. A frame without rows gives none; other columns, whatever their
    names, pass through (_class and _kept are replaced).
    """
    roots = classes(docs, id_col, text_col, threshold=threshold).withColumnRenamed("_t", "t")
    rows = numbered(docs, id_col, text_col, "near-rows")
    met = rows.select("t", "id", "id_null", "number").join(roots, "t", "left").withColumn("root", F.coalesce("root", "t"))
    first = met.groupBy("root").agg(F.min(F.struct("id_null", "id", "t", "number")).alias("least"))
    by_text = met.select("t", "root").distinct().join(first, "root").select("t", "least")
    out = rows.join(distinct_texts(docs, text_col), "t").join(by_text, "t")
    keep = [c for c in docs.columns if c not in ("_class", "_kept")]
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in keep], F.col("least.id").alias("_class"), (F.col("number") == F.col("least.number")).alias("_kept"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near copies: doc_id, class_id (its least doc_id), class_size, kept.

    Equal texts are one class, texts without words among them (null counts as
    empty); repeated rows stay; an empty table gives none.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    roots = classes(docs)
    slim = docs.select("doc_id", text_digest().alias("_t")).join(roots, "_t", "left").withColumn("_root", F.coalesce("root", "_t"))
    slim = written(slim.select("doc_id", "_root"), "near-classes")
    first = slim.groupBy("_root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return slim.join(first, "_root").select("doc_id", "class_id", "class_size", (F.col("doc_id") == F.col("class_id")).alias("kept"))
