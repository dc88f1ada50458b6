"""Alignment of two tokenizers' tokens by the bytes that they cover.

Both tokenizers' tokens cover the same bytes, so the cumulative ends of their tokens
are two ascending lists over one line. Their merge cuts the line at every end: each
stretch lies in one token of either side, which is a link; an end that both sides
share closes a group. A pair of ids counts once for every document that holds it
linked. The counts, and the highest for each id of either side, are joined back.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import released, sums_by_key, table, whole, written
from .tokens import SPELLED, encoder_of

#: Text that is aligned at once in a Python worker.
SLICE_BYTES = 2 << 20
#: Stretches that a Python worker keeps, about 300 bytes each, and that it aligns at once.
KEPT_STRETCHES = 250_000
LEARNED = 50_000
#: White space and what follows up to the next; a text with other white space than this is aligned as one stretch.
_STRETCHES = re.compile(r"[ \t\n\f\v]*[^ \t\n\f\v]+|[ \t\n\f\v]+")
_ODD_SPACE = re.compile("[\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u2581\u3000\ufeff]")
#: White space after another character, which no token may hold.
_OVER = re.compile(r"\S[ \t\n\f\v]")
#: Distinct pairs up to which their counts are broadcast, about 50 MB; beyond it rows and counts are shuffled by pair.
BROADCAST_PAIRS = 1_000_000
#: The rows of a pair are dealt over so many tasks where they are shuffled.
SALTS = 8

#: How byte-level vocabularies spell bytes, the other way round.
_BYTE_OF = {chr(code): byte for byte, code in ({b: b for b in range(256)} | SPELLED).items()}


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def token_bytes(vocabulary: str) -> list[bytes]:
    """The bytes of every id: a byte-level entry decoded; a piece as UTF-8 with U+2581 as a space, byte pieces as their byte."""
    encoder = encoder_of(vocabulary, False)
    if vocabulary.endswith(".model"):
        model = encoder.model
        return [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.get_piece_size())]
    entries = encoder.whole.get_vocab(with_added_tokens=True)
    out = [b""] * (max(entries.values()) + 1)
    for entry, i in entries.items():
        out[i] = bytes(_BYTE_OF[c] for c in entry) if all(c in _BYTE_OF for c in entry) else entry.encode()
    return out


class Side:
    """One tokenizer: ids of stretches of space + text, and their bytes. A sentencepiece model adds a space of its own."""

    def __init__(self, vocabulary: str):
        self.encoder = encoder_of(vocabulary, False)
        self.bytes = token_bytes(vocabulary)
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.names = [str(i) for i in range(len(self.bytes))]
        self.adds = vocabulary.endswith(".model")
        self.cuts = not any(_OVER.search(b.decode("utf-8", "replace")) for b in self.bytes) if self.adds else self.encoder.by_words
        self.space = self.encoder.model.piece_to_id("▁") if self.adds else -1

    def ids(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, how many each stretch has, and whether its tokens' bytes are its own."""
        if not self.adds:
            found = [x.ids for x in self.encoder.whole.encode_batch_fast(stretches, add_special_tokens=False)]
        else:
            found = self.encoder.model.encode([x.removeprefix(" ") for x in stretches], num_threads=1)
            found = [x if s.startswith(" ") else x[1:] if x and x[0] == self.space else [] for x, s in zip(found, stretches, strict=True)]
        n = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(itertools.chain.from_iterable(found), np.int64, n.sum())
        sizes = np.bincount(np.repeat(np.arange(len(n)), n), self.sizes[flat], len(n))
        own = [s.encode() for s in stretches]
        spelled = list(map(self.bytes.__getitem__, flat.tolist()))
        if (sizes == np.fromiter(map(len, own), np.int64, len(own))).all() and b"".join(spelled) == b"".join(own):
            return flat, n, np.ones(len(n), bool)
        to = np.cumsum(n).tolist()
        return flat, n, np.array([b"".join(spelled[low:high]) == s for low, high, s in zip([0, *to], to, own, strict=False)], bool)


def merged(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, closes) for each stretch between ends of two ascending lists with one last end: the tokens that cover it, and whether both end with it."""
    both = np.concatenate([a_ends, b_ends])
    both.sort(kind="stable")  # two ascending runs: one merge
    ends = both[np.concatenate(([True], both[1:] != both[:-1]))] if len(both) else both
    i, j = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
    return i, j, (a_ends[i] == ends) & (b_ends[j] == ends)


class Stretches:
    """Aligned stretches, one after another: counts, groups as text, and the keys of their links."""

    def __init__(self) -> None:
        self.counts = np.zeros((0, 4), np.int64)  # n_a, n_b, n_groups, n_links
        self.groups: list[str] = []
        self.at = np.zeros(1, np.int64)  # where each one's links begin
        self.links = np.zeros(0, np.int64)

    def extend(self, counts: np.ndarray, groups: list[str], links: np.ndarray) -> None:
        self.counts = np.concatenate([self.counts, counts])
        self.groups += groups
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(counts[:, 3])])
        self.links = np.concatenate([self.links, links])


class Aligner:
    def __init__(self, a: str, b: str):
        self.a, self.b = Side(a), Side(b)
        self.cuts = self.a.cuts and self.b.cuts
        self.pairs = len(self.a.names) * len(self.b.names)
        self.words = [n + s for n in self.a.names for s in (",", "|")] + [n + s for n in self.b.names for s in (",", ";")]
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.kept = Stretches()

    def _aligned(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
        """Whether each has tokens, and the counts, groups and links of those that have, all aligned in one merge."""
        (a, n_a, good_a), (b, n_b, good_b) = self.a.ids(stretches), self.b.ids(stretches)
        good = good_a & good_b
        a, b, n_a, n_b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)], n_a[good], n_b[good]
        n = len(n_a)
        if not n:
            return good, np.zeros((0, 4), np.int64), [], np.zeros(0, np.int64)
        i, j, closes = merged(np.cumsum(self.a.sizes[a]), np.cumsum(self.b.sizes[b]))
        owner = np.repeat(np.arange(n), n_a)[i]  # last ends are shared, so no link spans two stretches
        group = np.cumsum(closes) - closes
        group_a, group_b = np.empty(len(a), np.int64), np.empty(len(b), np.int64)
        group_a[i], group_b[j] = group, group
        # in writing order, a group's tokens of A come before those of B
        in_a, in_b = np.bincount(group_a), np.bincount(group_b)
        last_a, last_b = (np.concatenate([g[1:] != g[:-1], [True]]) for g in (group_a, group_b))
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]] = a * 2 + last_a
        order[np.arange(len(b)) + np.cumsum(in_a)[group_b]] = 2 * len(self.a.names) + b * 2 + last_b
        to = np.cumsum(n_a + n_b).tolist()
        written_ = list(map(self.words.__getitem__, order.tolist()))
        groups = ["".join(written_[low:high])[:-1] for low, high in zip([0, *to], to, strict=False)]
        counts = np.stack([n_a, n_b, np.bincount(owner, closes, n).astype(np.int64), np.bincount(owner, minlength=n)], axis=1)
        return good, counts, groups, a[i] * len(self.b.names) + b[j]

    def _learn(self, stretches: list[str]) -> None:
        for low in range(0, len(stretches), LEARNED):
            some = stretches[low : low + LEARNED]
            good, counts, groups, links = self._aligned(some)
            numbers = iter(range(len(self.kept.groups), len(self.kept.groups) + len(groups)))
            self.kept.extend(counts, groups, links)
            self.known.update((s, next(numbers) if g else -1) for s, g in zip(some, good.tolist(), strict=True))

    def align(self, texts: list[str]) -> dict[str, list]:
        """Columns over the texts."""
        n = len(texts)
        if len(self.known) > KEPT_STRETCHES:
            self.clear()
        cut = [_STRETCHES.findall(f" {t}") if t and self.cuts and not _ODD_SPACE.search(t) else None for t in texts]
        self._learn(list({s for x in cut if x for s in x} - self.known.keys()))
        numbers = [np.fromiter(map(self.known.__getitem__, x), np.int64, len(x)) if x else None for x in cut]
        whole_ = [k for k, t in enumerate(texts) if t and (numbers[k] is None or (numbers[k] < 0).any())]
        for k in whole_:
            numbers[k] = None
        counts, groups = np.zeros((n, 4), np.int64), [""] * n
        keys, times = [], []
        full = [k for k in range(n) if numbers[k] is not None]
        if full:
            flat = np.concatenate([numbers[k] for k in full])
            doc = np.repeat(full, [len(numbers[k]) for k in full])
            for c in range(4):
                counts[:, c] = np.bincount(doc, self.kept.counts[flat, c], n)
            for k in full:
                groups[k] = ";".join(map(self.kept.groups.__getitem__, numbers[k].tolist()))
            # a stretch's links once for every text, times how often it stands there
            where, often = np.unique(doc * len(self.kept.groups) + flat, return_counts=True)
            doc, flat = np.divmod(where, len(self.kept.groups))
            size = self.kept.counts[flat, 3]
            first = np.repeat(self.kept.at[flat] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            keys.append(np.repeat(doc, size) * self.pairs + self.kept.links[first])
            times.append(np.repeat(often, size))
        for k in whole_:
            good, count, group, links = self._aligned([f" {texts[k]}"])
            if good[0]:
                counts[k], groups[k] = count[0], group[0]
                keys.append(k * self.pairs + links)
                times.append(np.ones(len(links), np.int64))
        key, time = sums_by_key(np.concatenate(keys), np.concatenate(times)) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        to = np.searchsorted(key, np.arange(1, n + 1) * self.pairs).tolist()
        a, b = (x.astype(np.int32) for x in np.divmod(key % self.pairs, len(self.b.names)))
        time = time.astype(np.int32)
        split = lambda x: [x[low:high] for low, high in zip([0, *to], to, strict=False)]
        return {**{c: counts[:, i] for i, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))}, "groups": groups, "a": split(a), "b": split(b), "times": split(time)}


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner_of(a: str, b: str) -> Aligner:
    """One for each pair of vocabularies and Python worker."""
    if (a, b) not in _aligners:
        _aligners[a, b] = Aligner(a, b)
    return _aligners[a, b]


def _slices(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    low = size = 0
    for k, text in enumerate(frame["text"]):
        if k > low and size + len(text) > SLICE_BYTES:
            yield frame.iloc[low:k]
            low, size = k, 0
        size += len(text)
    if low < len(frame):
        yield frame.iloc[low:]


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """(id_col, n_a, n_b, n_groups, n_links, groups, a, b, times): one row for each of docs.

    groups: the groups as text, `a1,a2|b1;a3|b2`, ids in order. a, b, times: the
    document's linked pairs, each once, and how often it holds them. A null or empty
    text, and one whose tokens don't give its bytes again on both sides, has no
    tokens. Repeated rows stay; other columns are dropped; no rows give none.
    """
    ship(docs.sparkSession)
    a, b = vocabularies or default_vocabularies()
    kind = dict(docs.dtypes)[id_col]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = aligner_of(a, b)
        for frame in (x for y in frames for x in _slices(y)):
            yield pd.DataFrame({"id": frame["id"].to_numpy(), **aligner.align(frame["text"].tolist())})
        aligner.clear()
        released()

    shape = "id string, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, a array<int>, b array<int>, times array<int>"
    # as a string an id that may be null passes pandas as it is
    found = docs.select(F.col(id_col).cast("string").alias("id"), whole(F.col(text_col)).alias("text")).mapInPandas(run, shape)
    return found.select(F.col("id").cast(kind).alias(id_col), *found.columns[1:])


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, n, best_a, best_b): the documents that hold a pair linked, and the highest such count of a and of b."""
    pairs = aligned.select(F.explode(F.arrays_zip("a", "b")).alias("p")).groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    pairs = written(pairs, "pair-counts")
    best = lambda side: pairs.groupBy(side).agg(F.max("n").alias(f"best_{side}"))
    return pairs.join(best("a"), "a").join(best("b"), "b").select("a", "b", "n", "best_a", "best_b")


def link_counts(aligned: DataFrame, row_col: str, *, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """(row_col, n_best_a, n_best_b, count_sum) of every row of aligned that has links; row_col must be unique.

    n_best_a: links whose pair has the highest count of its a, ties included;
    n_best_b likewise; count_sum: the counts of all links. The counts' table grows
    with the vocabularies' pairs, not with the text; only up to broadcast_pairs rows are broadcast.
    """
    counts = written(pair_counts(aligned), "pair-best")
    links = aligned.select(row_col, F.inline(F.arrays_zip("a", "b", "times")))
    if counts.count() <= broadcast_pairs:
        met = links.join(F.broadcast(counts), ["a", "b"])
    else:
        dealt = counts.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        met = links.withColumn("salt", F.pmod(F.xxhash64(row_col), F.lit(SALTS)).cast("int")).join(dealt.hint("merge"), ["a", "b", "salt"])
    times = F.col("times").cast("bigint")
    best = lambda side: F.sum(F.when(F.col("n") == F.col(f"best_{side}"), times).otherwise(0)).alias(f"n_best_{side}")
    return met.groupBy(row_col).agg(best("a"), best("b"), F.sum(F.col("n") * times).alias("count_sum"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document.

    A null or empty text, or one that either side doesn't give again, has zeros and
    an empty groups_sha256; repeated rows and ids count and stay; an empty table gives none.
    """
    found = align(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.when(F.col("n_a") == 0, "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    rows = written(found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "a", "b", "times"), "aligned")
    counted = link_counts(rows, "row")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return rows.drop("a", "b", "times").join(counted, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", zero(F.col("n_best_a")).alias("n_best"), zero(F.col("count_sum")).alias("count_sum"), "groups_sha256"
    )
