"""Sampled subword segmentation: forward filtering, backward sampling.

A text's segments (a word with the spaces before it) have lattices over the
vocabulary's pieces. Forward filtering sums, for each place in a segment, the
weights of all ways to reach it; backward sampling then draws pieces from the end,
each in proportion to the weight of the ways it completes, so every segmentation
comes up with exactly its share of the total weight. Draws are hashes of the row's
key and the place in the text: a row is segmented the same way in any batch, on
any executor, at any retry. Characters outside the vocabulary become its byte
pieces, so that decoding gives every text back.

Weights follow the vocabulary's own ranking; a piece's weight is (rank + 2)^-SHARPNESS.
Segments are whole, however long; no piece of the vocabulary goes over their edges
(if one does, a text is one segment). Within a segment, filtering starts anew
wherever no piece crosses, which changes no share. Lattices of segments seen before
are kept in a table of bounded size; those of new ones are filtered side by side.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .common import boxed, released, table, unboxed, whole

SHARPNESS = 1.0
SEED = 17
#: Characters that are drawn together: few, so that their arrays stay in a processor's cache.
BATCH_CHARS = 250_000
#: Segments and characters whose lattices a Python worker keeps, some 130 MB.
KEPT_SEGMENTS = 350_000
KEPT_CHARS = 3_000_000

_SEGMENTS = re.compile(r" *[^ \n\t]+| +|[\n\t]")
_ACROSS = re.compile(r"[^ ] |[\n\t].|.[\n\t]", re.S)
_U = np.uint64


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The vocabulary, by the text a piece stands for; byte pieces by their byte."""

    def __init__(self, model: str, sharpness: float = SHARPNESS):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model)
        self.byte_id = np.full(256, -1, np.int64)
        self.bytes_of: list[bytes] = [b""] * sp.get_piece_size()
        self.of: dict[str, tuple[int, float]] = {}
        rank = 0
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):
                value = int(sp.id_to_piece(i)[3:5], 16)
                self.byte_id[value] = i
                self.bytes_of[i] = bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                text = sp.id_to_piece(i).replace("▁", " ")
                self.of[text] = (i, -sharpness * math.log(rank + 2))
                self.bytes_of[i] = text.encode()
                rank += 1
        self.longest = max(map(len, self.of))
        self.by_words = not any(map(_ACROSS.search, self.of))
        self.byte_weight = -sharpness * math.log(rank + 2)
        # every beginning of a piece by its hash, with the piece's id and log weight where it is one whole
        begun: dict[str, tuple[int, float]] = {}
        for text, own in self.of.items():
            for n in range(1, len(text)):
                begun.setdefault(text[:n], (-1, 0.0))
            begun[text] = own
        texts = list(begun)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.cumsum(sizes) - sizes
        codes, hashes = _codes("".join(texts)), np.zeros(len(texts), np.uint64)
        for n in range(self.longest):
            longer = np.flatnonzero(sizes > n)
            hashes[longer] = _roll(hashes[longer], codes[begin[longer] + n])
        # open addressing: a hash stands in the first free slot from its own on
        self.mask = (1 << (8 * len(texts) - 1).bit_length()) - 1
        self.slots = np.full(self.mask + 1, -1, np.int32)
        for i, h in enumerate(hashes.tolist()):
            at = h & self.mask
            while self.slots[at] >= 0:
                at = (at + 1) & self.mask
            self.slots[at] = i
        self.hashes = hashes
        self.ids = np.array([begun[t][0] for t in texts], np.int64)
        self.weights = np.array([begun[t][1] for t in texts])
        self.lattices = Lattices(self)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, or -1."""
        at = (h & _U(self.mask)).astype(np.int64)
        out = self.slots[at]
        open_ = np.flatnonzero((out >= 0) & (self.hashes[out] != h))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            out[open_] = self.slots[at[open_]]
            open_ = open_[(out[open_] >= 0) & (self.hashes[out[open_]] != h[open_])]
        return out

    def decode_batch(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """The texts of the ids from at[0] to at[1], from there to at[2] and so on."""
        if not hasattr(self, "blob"):
            self.blob, self.length = np.frombuffer(b"".join(self.bytes_of), np.uint8), np.fromiter(map(len, self.bytes_of), np.int64)
            self.begin = np.cumsum(self.length) - self.length
        ids = ids[at[0] : at[-1]]
        sizes = self.length[ids]
        ends = np.cumsum(sizes)
        data = self.blob[np.repeat(self.begin[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        offsets = np.concatenate(([0], ends))[at - at[0]].astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])

    def decode(self, ids: list[int]) -> str:
        return self.decode_batch(np.array(ids, np.int64), np.array([0, len(ids)]))[0].as_py()


def _roll(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    h = (h ^ code) * _U(0x9E3779B97F4A7C15)
    h ^= h >> _U(29)
    return h * _U(0xBF58476D1CE4E5B9)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _utf8_sizes(codes: np.ndarray) -> np.ndarray:
    return 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)


class Growing:
    """An array that grows at its end."""

    def __init__(self, kind):
        self.room, self.size = np.empty(1024, kind), 0

    def extend(self, more: np.ndarray) -> None:
        size = self.size + len(more)
        if size > len(self.room):
            self.room = np.concatenate((self.room[: self.size], np.empty(max(size, 2 * len(self.room)) - self.size, self.room.dtype)))
        self.room[self.size : size] = more
        self.size = size


class Lattices:
    """Filtered lattices of distinct segments, each place a node: the candidates for the piece that ends there.

    A node's candidates are edges first[node], first[node] + 1 and so on; upto holds
    their shares added up, in units of 2^-32 and less one, so that a draw goes to the
    first edge whose upto is no less.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.base, self.sizes = Growing(np.int64), Growing(np.int64)  # the node of place 1 of each segment, and its places
        self.first = Growing(np.int32)
        self.piece, self.long, self.upto = Growing(np.int32), Growing(np.uint8 if self.pieces.longest < 256 else np.int32), Growing(np.uint32)

    def numbers(self, segments: list[str]) -> np.ndarray:
        """The numbers of the segments, with lattices for all of them; a full table is emptied first."""
        found = np.fromiter(map(self.number.get, segments, itertools.repeat(-1)), np.int64, len(segments))
        missing = np.flatnonzero(found < 0).tolist()
        if not missing:
            return found
        new = list(dict.fromkeys(map(segments.__getitem__, missing)))
        if len(self.number) + len(new) > KEPT_SEGMENTS or self.first.size + sum(map(len, new)) > KEPT_CHARS:
            self.clear()
            self._add(list(dict.fromkeys(segments)))
            return np.fromiter(map(self.number.__getitem__, segments), np.int64, len(segments))
        self._add(new)
        found[missing] = list(map(self.number.__getitem__, map(segments.__getitem__, missing)))
        return found

    def _add(self, segments: list[str]) -> None:
        pieces = self.pieces
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        ends = np.cumsum(sizes)
        total = int(ends[-1])
        base = ends - sizes
        codes = _codes("".join(segments))
        stop = np.repeat(ends, sizes)
        alive, h = np.arange(total), np.zeros(total, np.uint64)
        single = np.zeros(total, bool)
        found: list[tuple] = []  # begin, finish, piece, weight of the edges of each length
        for n in range(1, pieces.longest + 1):
            keep = alive + n <= stop[alive]
            alive, h = alive[keep], h[keep]
            h = _roll(h, codes[alive + n - 1])
            at = pieces.find(h)
            hit = at >= 0
            alive, h, at = alive[hit], h[hit], at[hit]
            if not len(alive):
                break
            own = pieces.ids[at]
            is_piece = own >= 0
            begin = alive[is_piece]
            if n == 1:
                single[begin] = True
            found.append((begin, begin + (n - 1), own[is_piece], pieces.weights[at[is_piece]]))
        odd = np.flatnonzero(~single)
        found.insert(0, (odd, odd, np.full(len(odd), -1, np.int64), pieces.byte_weight * _utf8_sizes(codes[odd])))  # byte pieces
        count, over = np.zeros(total, np.int64), np.zeros(total + 2, np.int64)
        for begin, finish, _, _ in found:
            count[finish] += 1
            over[begin + 1] += 1
            over[finish + 1] -= 1
        # edges in order of the node where they finish, longest first: of one length, a node has one at most
        first = np.cumsum(count) - count
        size, filled = int(count.sum()), first.copy()
        start, piece, weight = np.empty(size, np.int64), np.empty(size, np.int32), np.empty(size)
        for begin, finish, own, value in reversed(found):
            at = filled[finish]
            start[at], piece[at], weight[at] = begin, own, value
            filled[finish] += 1
        # filtering starts anew before each character that no piece reaches over, side by side, place after place
        origin = np.maximum.accumulate(np.where(np.cumsum(over)[:total] == 0, np.arange(total), 0))
        level = np.arange(total) - origin
        by_level = np.argsort(level.astype(np.uint16) if level.max() < 1 << 16 else level, kind="stable")
        ends_at = np.cumsum(np.bincount(level)).tolist()
        reach = np.zeros(total + 1)  # log weight of all ways to each node
        upto = np.empty(size, np.uint32)
        low = 0
        for high in ends_at:
            node = by_level[low:high]
            low = high
            n = count[node]
            head = np.cumsum(n) - n
            edge = np.repeat(first[node] - head, n) + np.arange(head[-1] + n[-1])
            begin = start[edge]
            x = weight[edge] + np.where(begin > np.repeat(origin[node], n), reach[begin - 1], 0.0)
            most = np.maximum.reduceat(x, head)
            x = np.exp(x - np.repeat(most, n))
            sums = np.cumsum(x)
            before = np.concatenate(([0.0], sums))[head]
            all_ways = np.concatenate((sums[head[1:] - 1], sums[-1:])) - before
            upto[edge] = np.clip((sums - np.repeat(before, n)) / np.repeat(all_ways, n) * 2.0**32 - 1, 0, 2.0**32 - 1)
            reach[node] = most + np.log(all_ways)
        upto[first + count - 1] = 2**32 - 1
        for i, x in enumerate(segments, len(self.number)):
            self.number[x] = i
        self.base.extend(base + self.first.size)
        self.sizes.extend(sizes)
        self.first.extend(first + self.upto.size)
        self.long.extend(np.repeat(np.arange(total), count) - start + 1)
        self.piece.extend(piece)
        self.upto.extend(upto)


def _draw(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """32 bits, from the row's key and the place in its text."""
    x = key + place.astype(np.uint64) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return ((x ^ (x >> _U(31))) >> _U(32)).astype(np.uint32)


def row_key(key, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{seed}\x00{key}".encode(), digest_size=8).digest(), "little")


def sample_batch(pieces: Pieces, texts: list[str], keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts' sampled segmentations in one array, and where each text's begin and end in it."""
    found = [_SEGMENTS.findall(text) if pieces.by_words else [text] if text else [] for text in texts]
    lattices = pieces.lattices
    which = lattices.numbers(list(itertools.chain.from_iterable(found)))
    counts = np.fromiter(map(len, found), np.int64, len(found))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.concatenate(([0], np.cumsum(sizes)))
    out = np.zeros(begin[-1], np.int32)  # piece + 2 where one begins; 1 for byte pieces
    first, place = lattices.base.room[which], lattices.sizes.room[which]
    node_edge, upto, piece, long = lattices.first.room, lattices.upto.room, lattices.piece.room, lattices.long.room
    low = np.cumsum(place) - place  # segments cover the batch without gaps
    doc = np.repeat(np.arange(len(texts)), counts)
    key, inner = np.array(keys, np.uint64)[doc], low - begin[doc]
    while len(place):
        drawn, edge = _draw(key, inner + place), node_edge[first + place - 1]
        open_ = np.flatnonzero(upto[edge] < drawn)
        while len(open_):
            edge[open_] += 1
            open_ = open_[upto[edge[open_]] < drawn[open_]]
        place = place - long[edge]
        out[low + place] = piece[edge] + 2
        more = place > 0
        first, place, low, key, inner = first[more], place[more], low[more], key[more], inner[more]
    places = np.flatnonzero(out)
    ids = out[places].astype(np.int64) - 2
    units = np.ones(len(ids), np.int64)
    odd = np.flatnonzero(ids < 0)
    if len(odd):
        letters = np.array([ord(c) for c in map("".join(texts).__getitem__, places[odd].tolist())], np.int64)
        units[odd] = _utf8_sizes(letters)
    ends = np.cumsum(units)
    flat = np.repeat(ids, units)
    for n in range(1, 5) if len(odd) else ():
        some = odd[units[odd] == n]
        code, at = letters[units[odd] == n], ends[some] - n
        for i in range(n):
            tail = (code >> (6 * (n - 1 - i))) & 0x3F
            byte = code if n == 1 else (code >> (6 * (n - 1))) | (0xF00 >> n & 0xFF) if i == 0 else 0x80 | tail
            flat[at + i] = pieces.byte_id[byte]
    return flat, np.concatenate(([0], ends))[np.searchsorted(places, begin)]


def sample_ids(pieces: Pieces, texts: list[str], keys: list[int]) -> list[np.ndarray]:
    """The ids of each text's sampled segmentation."""
    flat, at = sample_batch(pieces, texts, keys)
    return [flat[a:b] for a, b in itertools.pairwise(at.tolist())]


_loaded: dict[tuple[str, float], Pieces] = {}


def pieces_of(model: str, sharpness: float = SHARPNESS) -> Pieces:
    """One for each model and Python worker."""
    if (model, sharpness) not in _loaded:
        _loaded[model, sharpness] = Pieces(model, sharpness)
    return _loaded[model, sharpness]


def _batches(texts: list[str]) -> Iterator[tuple[int, int]]:
    low, chars = 0, 0
    for i, text in enumerate(texts):
        if chars and chars + len(text) > BATCH_CHARS:
            yield low, i
            low, chars = i, 0
        chars += len(text)
    if low < len(texts):
        yield low, len(texts)


def segment(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, model: str | None = None, seed: int = SEED, sharpness: float = SHARPNESS) -> DataFrame:
    """Every row without text_col, with ids (array<int>), of a segmentation drawn for the row's id, and ids_crc32 (of unsigned little-endian 32-bit ids).

    A null or empty text has no ids. Equal ids and texts have equal segmentations;
    a null id is a key like any other. Texts are whole, of any length and with runs
    of any length without a space. Columns ids and ids_crc32 are replaced; others,
    whatever their names, pass through. A frame without rows gives none.
    """
    ship(docs.sparkSession)
    path = model or default_model()
    keep = [c for c in docs.columns if c not in (text_col, "ids", "ids_crc32")]
    ready = docs.select(boxed(docs, text_col, "ids", "ids_crc32"), F.col(id_col).cast("string").alias("key"), whole(F.col(text_col)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(path, sharpness)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            keys = [row_key(k, seed) for k in batch.column(1).to_pylist()]
            for a, b in _batches(texts):
                flat, at = sample_batch(pieces, texts[a:b], keys[a:b])
                flat = flat.astype("<i4")
                crc = [zlib.crc32(flat[low:high].tobytes()) for low, high in itertools.pairwise(at.tolist())]
                ids = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), ids, pa.array(crc, pa.int64())], ["row", "ids", "ids_crc32"])
        released()

    out = ready.mapInArrow(run, T.StructType([ready.schema["row"]]).add("ids", T.ArrayType(T.IntegerType())).add("ids_crc32", "long"))
    return out.select(*unboxed(keep), "ids", "ids_crc32")


def decode(rows: DataFrame, ids_col: str = "ids", *, model: str | None = None) -> DataFrame:
    """Every row with text: the exact text that the ids were drawn for. Null ids give the empty text.

    A column text is replaced; others pass through; a frame without rows gives none.
    """
    ship(rows.sparkSession)
    path = model or default_model()
    keep = [c for c in rows.columns if c not in (ids_col, "text")]
    ready = rows.select(boxed(rows, ids_col, "text"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(path)
        for batch in batches:
            ids = batch.column(1)
            ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.list_value_length(ids), 0), np.int64))
            at, flat, low = np.concatenate(([0], ends)), np.asarray(ids.flatten()), 0
            while low < batch.num_rows:  # a slice of few ids at a time, or of one row
                high = max(low + 1, int(np.searchsorted(at, at[low] + BATCH_CHARS, side="right")) - 1)
                yield pa.RecordBatch.from_arrays([*batch.slice(low, high - low).columns, pieces.decode_batch(flat, at[low : high + 1])], ["row", "ids", "text"])
                low = high
        released()

    out = ready.mapInArrow(run, T.StructType([*ready.schema.fields]).add("text", "string"))
    return out.select(*unboxed(keep), F.col("ids").alias(ids_col), "text")


def op8_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document segmented and decoded again: doc_id, n_chars, n_pieces, ids_crc32, decoded_sha256, ids.

    A null or empty text has no ids; its decoded text is empty. Repeated rows stay;
    an empty table gives none.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.char_length(whole(F.col("text"))).cast("bigint").alias("n_chars"))
    return decode(segment(docs)).select("doc_id", "n_chars", F.size("ids").cast("bigint").alias("n_pieces"), "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"), "ids")
