"""Removal of repeated byte strings by suffix order and longest previous factors.

A suffix array of the whole corpus fits no task, so suffixes are first dealt out
so that equal ones meet. Every window of min_bytes bytes takes the least hash of
the k-grams in it as its key. Neighbouring windows with one key form a block, and
equal windows have equal keys wherever they stand, so blocks with a key of their
own need no comparison. Equal blocks collapse to one with a count.

The distinct blocks that share a key are dealt by key into buckets of a bounded
size. Where no window has the hash of another, no factor can begin; the rest of a
bucket is sorted by suffix, by prefix doubling, dropping suffixes as soon as they are alone. In suffix order, the nearest suffixes before and after that stand
earlier in the text (previous and next smaller positions) hold the longest previous
factor of each; those that stand later, the longest next factor. A place whose
previous factor has min_bytes or more has an earlier copy and goes as far as the
factor reaches, so the first copy stays; where no copy is to stay, next factors
count too. A key with too many distinct blocks for one bucket (the edges of a
passage that a large share of all documents holds) is compared window by window,
by 128-bit digests that are counted before they are shuffled.

With min_words, all of this is done over words, each coded as a 64-bit hash, so
that windows of that many words are compared whatever their bytes.

Texts of fewer than min_bytes bytes, or min_words words, lose nothing. Repeated rows and copies of a
text share one text digest, so a hot text costs one row for each task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import WORD_CLASS, Scope, distinct_texts, numbered, order_of, pieces_by_bytes, released, table, text_digest, whole, word_hashes, word_hashes_of, written

MIN_BYTES = 400
#: Bytes of the k-grams that decide a window's key.
GRAM = 32
#: Words of those that decide a window of words' key.
WORD_GRAM = 8
#: Window starts that are hashed at once.
SEGMENT = 1 << 20
#: Bytes of short texts that are hashed at once: many enough to share numpy's calls, few enough for a processor's cache.
BATCH_BYTES = 128 << 10
#: Bytes of block text that a suffix order is built over, so that its arrays stay in a processor's cache.
BUCKET_BYTES = 256 << 10
#: Windows of a key beyond which they are compared by digest.
HOT_WINDOWS = 8 << 20
#: Text that a Python worker holds as rows.
SLICE_BYTES = 2 << 20
#: Words of a passage that counts as long.
PASSAGE_WORDS = 51
#: Distinct blocks of a key beyond which its windows are compared by digest.
HOT_BLOCKS = 2_000

_rng = np.random.default_rng(20_240_229)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_WORD = re.compile(WORD_CLASS.encode())


def _coded(text: str, words: bool) -> bytes:
    """The text's bytes, or for each of its words eight bytes of hash."""
    data = text.encode()
    return word_hashes(data).tobytes() if words else data


def _coded_all(texts: list[bytes]) -> list[bytes]:
    """Each text's words, coded; texts of up to BATCH_BYTES together are coded at once."""
    out: list[bytes] = []
    low = size = 0
    for i, text in enumerate([*texts, None]):
        if i > low and (text is None or size + len(text) > BATCH_BYTES):
            out += [h.tobytes() for h in word_hashes_of(texts[low:i])]
            low, size = i, 0
        size += len(text or b"")
    return out


def _units(coded: bytes, words: bool) -> np.ndarray:
    return np.frombuffer(coded, np.uint64 if words else np.uint8)


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the gram bytes (or coded words) from each position; gram is a power of two."""
    h = _BYTE[data] if data.dtype == np.uint8 else data
    step = 1
    while step < gram:
        h = h[:-step] * _ODD + (h[step:] ^ (h[step:] >> np.uint64(29)))
        step *= 2
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(32)
    return h


def _sliding(h: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over each run of width values."""
    step = 1
    while step * 2 <= width:
        h = pick(h[:-step], h[step:])
        step *= 2
    rest = width - step
    return pick(h[:-rest], h[rest:]) if rest else h


def _segments(texts: list[bytes], min_bytes: int, unit: int) -> Iterator[tuple[list[int], list[int], list[int], bytes]]:
    """Numbers of texts, first units, sizes in units and bytes of short texts together, and of the segments of long ones, which overlap by a window."""
    number: list[int] = []
    low: list[int] = []
    held: list[bytes] = []
    size = 0
    for i, text in enumerate(texts):
        for start in range(0, max(len(text) // unit - min_bytes + 1, 0), SEGMENT):
            part = text if len(text) // unit < SEGMENT else text[start * unit : (start + SEGMENT + min_bytes - 1) * unit]
            if held and size + len(part) > BATCH_BYTES:
                yield number, low, [len(x) // unit for x in held], b"".join(held)
                number, low, held, size = [], [], [], 0
            number.append(i)
            low.append(start)
            held.append(part)
            size += len(part)
    if held:
        yield number, low, [len(x) // unit for x in held], b"".join(held)


def blocks_of_all(texts: list[bytes], min_bytes: int, gram: int, words: bool) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """The number of blocks of each text; starts, numbers of windows, keys, content digests and whether a key's k-gram recurs within the text, of all blocks in order.

    With words, texts are coded and all places and sizes count words. Short texts
    share one pass of every step: windows over the edge of two are left out.
    """
    unit, width = 8 if words else 1, min_bytes - gram + 1
    counts = np.zeros(len(texts), np.int64)
    kinds = (np.int64, np.int32, np.int64, np.int64, bool)
    out: tuple[list[np.ndarray], ...] = tuple([np.zeros(0, k)] for k in kinds)
    for number, low, lengths, joined in _segments(texts, min_bytes, unit):
        data, ends = _units(joined, words), np.cumsum(lengths)
        starts, last = ends - lengths, ends - min_bytes + 1  # last: the end of a text's windows
        h = _gram_hashes(data, gram)
        least = _sliding(h, width, np.minimum)
        step = np.zeros(len(data) + 1, np.int8)
        step[starts] += 1
        step[last] -= 1
        within = np.cumsum(step[: len(least)], dtype=np.int8) > 0
        head = np.ones(len(least), bool)
        head[1:] = least[1:] != least[:-1]
        head[starts] = True
        edges = np.flatnonzero(head & within)
        piece = np.searchsorted(ends, edges, "right")
        sizes = np.minimum(np.append(edges[1:], len(data)), last[piece]) - edges
        padded = np.zeros(len(least) + 2 * (width - 1), np.uint64)
        np.copyto(padded[width - 1 : width - 1 + len(least)], least, where=within)
        places = np.flatnonzero(_sliding(padded, width, np.maximum) == h)  # the k-grams that are least in a window
        # a k-gram and its text as one number: were two alike by chance, a block would be compared to no avail
        of_text = lambda values, at: values * _MIX + (at.astype(np.uint64) + np.uint64(1)) * _ODD
        met = np.sort(of_text(h[places], np.searchsorted(ends, places, "right")))
        keys = least[edges]
        again = np.isin(of_text(keys, piece), met[1:][met[1:] == met[:-1]])
        digests = [xxhash.xxh3_64_intdigest(joined[s * unit : (s + n + min_bytes - 1) * unit]) for s, n in zip(edges.tolist(), sizes.tolist(), strict=True)]
        np.add.at(counts, np.array(number)[piece], 1)
        for to, v in zip(out, (edges + (np.array(low) - starts)[piece], sizes, keys.view(np.int64), (np.array(digests, np.uint64) ^ np.uint64(1 << 63)).view(np.int64), again), strict=True):
            to.append(v)
    return counts, tuple(np.concatenate(v).astype(k, copy=False) for v, k in zip(out, kinds, strict=True))


def blocks_of(text: bytes, min_bytes: int = MIN_BYTES, gram: int = GRAM, words: bool = False) -> tuple[list[int], list[int], list[int], list[int], list[bool]]:
    """blocks_of_all() of one text."""
    return tuple(v.tolist() for v in blocks_of_all([text], min_bytes, gram, words)[1])


def _sliced(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from pieces_by_bytes(batch, column, SLICE_BYTES)


def _mark(batches: Iterator[pa.RecordBatch], min_bytes: int, words: bool) -> Iterator[pa.RecordBatch]:
    for batch in _sliced(batches):
        texts = [x.encode() for x in batch.column("text").to_pylist()]
        counts, blocks = blocks_of_all(_coded_all(texts) if words else texts, min_bytes, WORD_GRAM if words else GRAM, words)
        offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
        columns = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in blocks]
        yield pa.RecordBatch.from_arrays([batch.column("t"), batch.column("o"), *columns], ["t", "o", "at", "n", "key", "h", "again"])
    released()


def _sorted_pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The order of the pairs, equal ones by index; in one sort of packed numbers where these fit."""
    bits = [max(1, int(x.max()).bit_length()) for x in (first, second)] + [max(1, (len(first) - 1).bit_length())]
    if sum(bits) > 64:
        return np.lexsort((second, first))
    packed = (first.astype(np.uint64) << np.uint64(bits[1] + bits[2])) | (second.astype(np.uint64) << np.uint64(bits[2]))
    packed |= np.arange(len(first), dtype=np.uint64)
    packed.sort()
    return (packed & np.uint64((1 << bits[2]) - 1)).astype(np.int64)


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Whether an element differs from the one before in any column."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = False
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def suffix_ranks(data: np.ndarray, ends: np.ndarray) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
    """Ranks of the suffixes of the blocks that end at ends, by their first units: (number of units, ranks) for ever more units.

    Suffixes end with their block; ranks have places to spare past the last. Also
    the final ranks, in full suffix order, where equal suffixes have one rank.
    """
    size = len(data)
    stop = np.repeat(ends, np.diff(np.concatenate(([0], ends))))
    if data.dtype == np.uint8:
        present = np.bincount(data, minlength=256) > 0
        code = np.cumsum(present)[data].astype(np.uint64)
    else:
        code = np.unique(data, return_inverse=True)[1].astype(np.uint64) + np.uint64(1)
    width = max(1, int(code.max()).bit_length()) if size else 1
    at_once = max(1, (63 - size.bit_length()) // width)
    padded = np.concatenate((code, np.zeros(at_once, np.uint64)))
    key = np.zeros(size, np.uint64)
    place = np.arange(size)
    for i in range(at_once):
        key = (key << np.uint64(width)) | np.where(place + i < stop, padded[i : i + size], np.uint64(0))
    order = _sorted_pairs(key, np.zeros(size, np.uint64)) if size else place
    longest = int((stop - place).max()) if size else 0
    rank = np.zeros(size + longest + 1, np.int64)  # 0 past a block's end
    head = _heads(key[order])
    starts = np.flatnonzero(head)
    sizes = np.diff(np.append(starts, size))
    rank[order] = np.repeat(starts, sizes) + 1
    many = np.zeros(size, bool)
    many[order] = np.repeat(sizes, sizes) > 1
    active, depth = np.flatnonzero(many), at_once
    levels = [(depth, rank[:size].astype(np.int32))]
    while len(active) and depth < longest:
        ahead = active + depth
        second = np.where(ahead < stop[active], rank[ahead], 0)
        old = rank[active]
        order = _sorted_pairs(old, second)
        old, second, moved = old[order], second[order], active[order]
        head, group = _heads(old, second), _heads(old)
        starts = np.flatnonzero(head)
        sizes = np.diff(np.append(starts, len(moved)))
        group_start = np.maximum.accumulate(np.where(group, np.arange(len(moved)), 0))
        rank[moved] = old + np.repeat(starts, sizes) - group_start
        active = np.sort(moved[np.repeat(sizes, sizes) > 1])
        depth *= 2
        levels.append((depth, rank[:size].astype(np.int32)))
    return levels, rank[:size]


def _common_prefix(levels: list[tuple[int, np.ndarray]], code: np.ndarray, left: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Units that the suffixes at a and b share; left: units to the end of each one's block."""
    most = np.minimum(left[a], left[b])
    out = np.zeros(len(a), np.int64)
    last = len(code) - 1
    for depth, rank in reversed(levels):
        same = (out < most) & (rank[np.minimum(a + out, last)] == rank[np.minimum(b + out, last)])
        out[same] += depth
    for _ in range(levels[0][0]):
        same = (out < most) & (code[np.minimum(a + out, last)] == code[np.minimum(b + out, last)])
        out[same] += 1
    return np.minimum(out, most)


def _nearest(position: np.ndarray, shared: np.ndarray, least: int) -> np.ndarray:
    """For each suffix, what it shares with the nearest one before it in suffix order of a smaller position; 0 for under least.

    shared: with the one just before. Pointers jump over those of greater positions.
    """
    before, common = np.arange(len(position)) - 1, shared.copy()
    before[common < least] = -1
    open_ = np.flatnonzero((before >= 0) & (position[before] > position))
    while len(open_):
        over = before[open_]
        common[open_], before[open_] = np.minimum(common[open_], common[over]), before[over]
        before[open_[common[open_] < least]] = -1
        open_ = open_[before[open_] >= 0]
        open_ = open_[position[before[open_]] > position[open_]]
    return np.where(before >= 0, common, 0)


def _window_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A hash of the length units from each place."""
    h, step = _BYTE[data] if data.dtype == np.uint8 else data, 1
    while step * 2 <= length:
        h = h[:-step] * _ODD + (h[step:] ^ (h[step:] >> np.uint64(29)))
        step *= 2
    rest = length - step
    return h[:-rest] * _MIX + (h[rest:] ^ (h[rest:] >> np.uint64(31))) if rest else h


def repeated_regions(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The places under windows whose hash another window has, and where regions of them end among these: no factor of length lies elsewhere."""
    size = len(data)
    left = np.repeat(ends, np.diff(np.concatenate(([0], ends)))) - np.arange(size)
    at = np.flatnonzero(left >= length)
    if not len(at):
        return at, at
    h = _window_hashes(data, length)[at]
    ordered = np.sort(h)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return at[:0], at[:0]
    at = at[twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h]
    edge = np.zeros(size + 1, np.int64)
    edge[at] += 1
    edge[at + length] -= 1
    places = np.flatnonzero(np.cumsum(edge[:size]) > 0)
    last = np.ones(len(places), bool)
    last[:-1] = (places[1:] != places[:-1] + 1) | (left[places[:-1]] == 1)
    return places, np.flatnonzero(last) + 1


def factors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The longest previous factor and the longest next factor at every place of the blocks that end at ends; 0 for under length."""
    previous, following = np.zeros(len(data), np.int64), np.zeros(len(data), np.int64)
    places, region_ends = repeated_regions(data, ends, length)
    if len(places):
        previous[places], following[places] = _factors(data[places], region_ends, length)
    return previous, following


def _factors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """factors() of the regions, all of whose places are sorted."""
    size = len(data)
    previous, following = np.zeros(size, np.int64), np.zeros(size, np.int64)
    levels, rank = suffix_ranks(data, ends)
    place = np.arange(size)
    left = np.repeat(ends, np.diff(np.concatenate(([0], ends)))) - place
    # the suffixes that share length units with another, in suffix order
    depth, near = max((x for x in levels if x[0] <= length), key=lambda x: x[0], default=levels[0])
    some = np.flatnonzero(left >= length)
    if depth <= length:
        some = some[np.bincount(near, minlength=size + 2)[near[some]] > 1]
    if not len(some):
        return previous, following
    some = some[_sorted_pairs(rank[some], np.zeros(len(some), np.int64))]
    shared = np.zeros(len(some), np.int64)
    shared[1:] = _common_prefix(levels, data, left, some[:-1], some[1:])
    back = np.concatenate((shared[1:], [0]))[::-1]
    for out, position in ((previous, some), (following, -some)):
        out[some] = np.maximum(_nearest(position, shared, length), _nearest(position[::-1], back, length)[::-1])
    return previous, following


def _covered(length: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The block, by number, of each run of windows [a, b) under the factors, and its a and b within the block.

    Factors begin at each place, have the given lengths and end with the block that
    they are in; the blocks end at ends.
    """
    at = np.flatnonzero(length >= least)
    block = np.searchsorted(ends, at, "right")
    reach = np.maximum.accumulate(at + length[at])
    first = np.ones(len(at), bool)
    first[1:] = (at[1:] > reach[:-1]) | (block[1:] != block[:-1])
    last = np.ones(len(at), bool)
    last[:-1] = first[1:]
    block = block[first]
    start = np.concatenate(([0], ends))[block]
    return block, at[first] - start, reach[last] - least + 1 - start


def _order_bucket(group: pa.Table, min_bytes: int, first: bool, words: bool) -> pa.Table:
    """key, h and the runs of windows [a, b) that have a partner (an earlier one, to keep the first)."""
    group = group.sort_by([("o", "ascending"), ("at", "ascending"), ("h", "ascending")])
    texts = group.column("block").to_pylist()
    data, ends = _units(b"".join(texts), words), np.cumsum([len(x) // (8 if words else 1) for x in texts])
    earlier, later = factors(data, ends, min_bytes)
    block, a, b = _covered(earlier if first else np.maximum(earlier, later), ends, min_bytes)
    offsets = np.concatenate(([0], np.cumsum(np.bincount(block, minlength=len(ends)))))
    runs = pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in (a, b)], ["a", "b"])
    return pa.table({"key": group.column("key"), "h": group.column("h"), "runs": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs)})


def _cut_blocks(batches: Iterator[pa.RecordBatch], min_bytes: int, words: bool) -> Iterator[pa.RecordBatch]:
    """The texts of the blocks that are compared in suffix order."""
    names, unit = ["key", "h", "o", "at", "block"], 8 if words else 1
    for batch in _sliced(batches):
        out: list[list] = [[], [], [], [], []]
        for text, order, cand in zip(*(batch.column(c).to_pylist() for c in ("text", "o", "cand")), strict=True):
            data = _coded(text, words)
            for x in cand:
                if x["role"] == 1:
                    for to, v in zip(out, (x["key"], x["h"], order, x["at"], data[x["at"] * unit : (x["at"] + x["n"] + min_bytes - 1) * unit]), strict=True):
                        to.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), batch.column("o").type, pa.int64(), pa.binary()), strict=True)], names)
    released()


def _cut_windows(batches: Iterator[pa.RecordBatch], min_bytes: int, words: bool) -> Iterator[pa.RecordBatch]:
    """The windows of hot keys' blocks, as digests."""
    names, unit = ["key", "h", "o", "at", "off", "digest"], 8 if words else 1
    for batch in _sliced(batches):
        kinds = (pa.int64(), pa.int64(), batch.column("o").type, pa.int64(), pa.int32(), pa.binary())
        for text, order, cand in zip(*(batch.column(c).to_pylist() for c in ("text", "o", "cand")), strict=True):
            data = _coded(text, words)
            for x in cand:
                if x["role"] == 2:
                    for low in range(0, x["n"], 65_536):
                        count = min(65_536, x["n"] - low)
                        digests = [xxhash.xxh3_128_digest(data[s * unit : (s + min_bytes) * unit]) for s in range(x["at"] + low, x["at"] + low + count)]
                        same = [[v] * count for v in (x["key"], x["h"], order, x["at"])]
                        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip((*same, range(low, low + count), digests), kinds, strict=True)], names)
    released()


def _join_runs(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _remove(batches: Iterator[pa.RecordBatch], min_bytes: int, words: bool) -> Iterator[pa.RecordBatch]:
    for batch in _sliced(batches):
        removed, spans, kept, digests = [], [], [], []
        for text, marks in zip(batch.column("text").to_pylist(), batch.column("marks").to_pylist(), strict=True):
            data = text.encode()
            runs = _join_runs([(x["at"] + r["a"], x["at"] + r["b"] + min_bytes - 1) for x in marks for r in x["runs"]])
            if words:
                edges = [w.span() for w in _WORD.finditer(data)]
                runs = [(edges[a][0], edges[b - 1][1]) for a, b in runs]
            rest = b"".join(data[a:b] for a, b in zip([0, *(r[1] for r in runs)], [*(r[0] for r in runs), len(data)], strict=True))
            removed.append(len(data) - len(rest))
            spans.append(len(runs))
            kept.append(rest.decode(errors="ignore"))
            digests.append(hashlib.sha256(rest).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("t"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string()), pa.array(digests, pa.string())],
            ["t", "n_removed", "n_spans", "kept", "kept_sha256"],
        )
    released()


def _long_enough(text: Column, min_bytes: int, min_words: int | None) -> Column:
    return F.octet_length(text) >= min_bytes if min_words is None else F.regexp_count(text, F.lit(WORD_CLASS)) >= min_words


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_bytes: int = MIN_BYTES, keep_first: bool = False, min_words: int | None = None) -> DataFrame:
    """(t, n_removed, n_spans, kept, kept_sha256) for each distinct text, by its digest, that may lose bytes.

    keep_first: only windows with an earlier equal one go, in order of the least id
    of a text, then place; copies of a text after the first go whole (see dedup_substrings). min_words: windows
    of so many words (over WORD_GRAM) instead of min_bytes bytes. Ids that aren't whole numbers are ordered as
    strings; null ids come first; null texts count as empty. Other columns don't matter.
    """
    ship(docs.sparkSession)
    words, least = min_words is not None, min_bytes if min_words is None else min_words
    texts = docs.select(text_digest(text_col).alias("t"), order_of(docs, id_col).alias("o"), whole(F.col(text_col)).alias("text"))
    # of shorter texts no window is cut; so many words take at least a letter each and a space between
    texts = texts.where(F.octet_length("text") >= (2 * least - 1 if words else least))
    kind = dict(texts.dtypes)["o"]
    marked = texts.mapInArrow(lambda it: _mark(it, least, words), f"t binary, o {kind}, at array<bigint>, n array<int>, key array<bigint>, h array<bigint>, again array<boolean>")
    each = marked.groupBy("t").agg(F.min("o").alias("o"), F.count(F.lit(1)).alias("copies"), F.first(F.arrays_zip("at", "n", "key", "h", "again")).alias("b"))
    each = written(each, "suffix-marks")  # read twice below; two plans with other columns would hash the texts twice
    blocks = each.select("t", "o", "copies", F.inline("b"))
    shared = blocks.groupBy("key").agg(F.sum("copies").alias("c"), F.max("again").alias("a")).where((F.col("c") > 1) | F.col("a")).select("key")
    cand = written(blocks.join(shared, "key", "left_semi"), "suffix-blocks")
    # distinct blocks, and how many of them share a key
    distinct = cand.groupBy("key", "h").agg(F.sum("copies").alias("m"), F.min(F.struct("o", "at", "t")).alias("rep"), F.max("again").alias("a"), F.first("n").alias("w"))
    by_key = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("d"), F.sum("w").alias("w"))
    known = cand.join(distinct.drop("w").join(by_key, "key"), ["key", "h"])
    is_rep = (F.col("rep.t") == F.col("t")) & (F.col("rep.at") == F.col("at"))
    hot_key = (F.col("d") > HOT_BLOCKS) | ((F.col("d") > 1) & (F.col("w") > HOT_WINDOWS))
    role = F.when(is_rep & hot_key, 2).when(is_rep & ((F.col("d") > 1) | F.col("a")), 1).otherwise(0)
    gone = ~is_rep if keep_first else F.col("m") > 1
    lists = known.groupBy("t").agg(F.first("o").alias("o"), F.collect_list(F.struct("key", "h", "at", "n", role.alias("role"), gone.alias("gone"))).alias("cand"))
    one_each = texts.groupBy("t").agg(F.first("text").alias("text"))  # one of each text from every task, before the shuffle
    held = written(one_each.join(lists, "t"), "suffix-texts")
    # bounded buckets by key
    size = held.select(F.explode("cand").alias("x")).where("x.role = 1").agg(F.sum(F.col("x.n") + least - 1)).first()[0] or 0
    buckets = max(1, -(-size * (8 if words else 1) // BUCKET_BYTES))
    cut = held.where(F.exists("cand", lambda x: x["role"] == 1)).select("text", "o", "cand").mapInArrow(lambda it: _cut_blocks(it, least, words), f"key bigint, h bigint, o {kind}, at bigint, block binary")
    ordered = cut.groupBy(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")).applyInArrow(lambda g: _order_bucket(g, least, keep_first, words), "key bigint, h bigint, runs array<struct<a:int,b:int>>")
    hot = held.where(F.exists("cand", lambda x: x["role"] == 2)).select("text", "o", "cand").mapInArrow(lambda it: _cut_windows(it, least, words), f"key bigint, h bigint, o {kind}, at bigint, off int, digest binary")
    hot = written(hot, "suffix-hot")
    again = hot.groupBy("digest").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("o", "at", "h", "off")).alias("rep")).where("c > 1")
    met = hot.join(again, "digest")
    if keep_first:
        met = met.where(~((F.col("rep.o") == F.col("o")) & (F.col("rep.at") == F.col("at")) & (F.col("rep.h") == F.col("h")) & (F.col("rep.off") == F.col("off"))))
    by_window = met.groupBy("key", "h").agg(F.collect_list(F.struct(F.col("off").alias("a"), (F.col("off") + 1).alias("b"))).alias("runs"))
    runs = ordered.unionByName(by_window).where(F.size("runs") > 0)
    places = held.select("t", F.inline("cand")).join(runs, ["key", "h"], "left")
    whole_run = F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b")))
    marks = places.withColumn("runs", F.when(F.col("gone"), whole_run).otherwise(F.col("runs"))).where(F.col("runs").isNotNull())
    marks = marks.groupBy("t").agg(F.collect_list(F.struct("at", "runs")).alias("marks"))
    return held.select("t", "text").join(marks, "t").mapInArrow(lambda it: _remove(it, least, words), "t binary, n_removed bigint, n_spans bigint, kept string, kept_sha256 string")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_bytes: int = MIN_BYTES, keep_first: bool = True, min_words: int | None = None) -> DataFrame:
    """Every row with its text less the bytes under a min_bytes string that also starts elsewhere, and _n_removed, _n_spans.

    min_words: less the words under a run of so many words that also starts elsewhere,
    whatever white space is between them; the white space around a span stays.

    keep_first: of equal strings the first stays (by least id of the text, then
    place; ids that aren't whole numbers as strings), and of equal texts the row with
    the least id; otherwise all go. Spans overlap freely and are judged on the input.
    A character cut by a span's edge goes whole. Null texts count as empty and
    become so; null ids come first. Rows with one id and one text count as copies; of
    these the first by row stays. Other columns, whatever their names, pass through
    (_n_removed and _n_spans are replaced); a frame without rows gives none.
    """
    found = removals(docs, id_col, text_col, min_bytes=min_bytes, keep_first=keep_first, min_words=min_words)
    rows = numbered(docs, id_col, text_col, "suffix-rows")
    texts = distinct_texts(docs, text_col).join(found.select("t", "n_removed", "n_spans", "kept"), "t", "left")
    if keep_first:
        firsts = rows.groupBy("t").agg(F.min(F.struct("id_order", "number")).alias("first"))
        texts = texts.join(firsts, "t")
        copy = _long_enough(F.col("text"), min_bytes, min_words) & (F.col("number") != F.col("first.number"))
    else:
        copy = F.lit(False)
    joined = rows.join(texts, "t")
    kept = F.when(copy, F.lit("")).otherwise(F.coalesce("kept", "text"))
    zero = F.lit(0).cast("bigint")
    names = [c for c in docs.columns if c not in ("_n_removed", "_n_spans")]
    return joined.select(
        *[kept.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names],
        F.when(copy, F.octet_length("text").cast("bigint")).otherwise(F.coalesce("n_removed", zero)).alias("_n_removed"),
        F.when(copy, F.lit(1).cast("bigint")).otherwise(F.coalesce("n_spans", zero)).alias("_n_spans"),
    )


def _settled(found: DataFrame, label: str, tables: Scope) -> DataFrame:
    """The rows as a table of their own; those that they were made from go."""
    with Scope():
        kept = written(found, label)
    tables.begin()
    return kept


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 by 400-byte strings; n_passages, n_passage_bytes, repeats.

    n_passages and n_passage_bytes are the spans and bytes under runs of over 50 words
    that also stand elsewhere, whatever their bytes; repeats is true where either
    kind is found. A null or empty text loses nothing; repeated rows lose all that
    they share; an empty table gives none.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    with Scope() as tables:
        found = _settled(removals(docs).select("t", "n_removed", "n_spans", "kept_sha256"), "suffix-found", tables)
    with Scope() as tables:
        passages = removals(docs, min_words=PASSAGE_WORDS).select("t", F.col("n_removed").alias("n_passage_bytes"), F.col("n_spans").alias("n_passages"))
        passages = _settled(passages, "suffix-passages", tables)
    text = whole(F.col("text"))
    rows = docs.select("doc_id", text_digest().alias("t"), F.octet_length(text).cast("bigint").alias("n_bytes"), F.sha2(text, 256).alias("sha"))
    zero = F.lit(0).cast("bigint")
    out = rows.join(found, "t", "left").join(passages, "t", "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", zero).alias("n_removed"),
        F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
        F.coalesce("n_passages", zero).alias("n_passages"),
        F.coalesce("n_passage_bytes", zero).alias("n_passage_bytes"),
    )
    return out.withColumn("repeats", (F.col("n_removed") > 0) | (F.col("n_passage_bytes") > 0))
