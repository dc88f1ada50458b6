"""Token ids of whole texts by the public word BPE, with a cache of words.

Texts whose characters all lie in the vetted ranges below are normalised and split
here, and each distinct word is encoded once for each Python worker; the ids are
those of the library. All other texts, and those that hold an added token of the
vocabulary, go through the library whole.
"""

from __future__ import annotations

import re
import struct

#: Characters for which NFC changes nothing and letters, digits and marks are known: ASCII, Latin-1 and Latin Extended letters, common punctuation.
_KNOWN = re.compile(r"[\t\n\r\x20-\x7e¡-§©«¬®°±¶·»¿-ķĹ-ňŊ-ž‐-‣…‰-›€™]*")
#: The tokenizer's split, for lower-cased text of those ranges.
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ƀ]+|[0-9]|[^\sa-zß-öø-ƀ0-9]+")
#: Words kept by a Python worker in each of two generations, about 200 bytes each: 40 MB in all.
CACHE_WORDS = 100_000
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHERS = [b for b in range(256) if b not in _PRINTED]
#: How byte-level vocabularies spell bytes: printable ones as themselves, the others from U+0100 on.
SPELLED = {b: 256 + i for i, b in enumerate(_OTHERS)}


class WordIds:
    """ids_of: the ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(vocabulary)
        added = [t.content.lower() for t in self.whole.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")  # the library matches these before it splits
        self.model = self.whole.model
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # the generation before; words seen again move on

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        """The model alone; the vocabulary spells bytes as printable characters."""
        return self._bytes([t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(SPELLED))])

    def ids_of(self, text: str) -> bytes:
        lower = text.lower()
        if self.added.search(lower) or not _KNOWN.fullmatch(text):
            return self._bytes(self.whole.encode(text, add_special_tokens=False).ids)
        found = _WORDS.findall(lower)
        try:
            return b"".join(map(self.known.__getitem__, found))
        except KeyError:
            pass
        missing = dict.fromkeys(w for w in found if w not in self.known)
        fresh = {w: self.older[w] for w in missing if w in self.older}
        fresh |= {w: self._word(w) for w in missing if w not in fresh}
        out = b"".join([self.known[w] if w in self.known else fresh[w] for w in found])
        if len(self.known) + len(fresh) > CACHE_WORDS:
            self.older, self.known = self.known, {}
        if len(fresh) <= CACHE_WORDS:
            self.known |= fresh
        return out


    def forget(self) -> None:
        """Drops the kept words: the worker lives on beside those of later stages."""
        self.known, self.older = {}, {}


_loaded: dict[str, WordIds] = {}


def word_ids(vocabulary: str) -> WordIds:
    """One for each vocabulary and Python worker."""
    if vocabulary not in _loaded:
        _loaded[vocabulary] = WordIds(vocabulary)
    return _loaded[vocabulary]


#: Words of byte-level vocabularies that split by the usual pattern: contractions, letters, digits and others, each with the space before it, and runs of white space (fixed value).
_BYTE_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Blocks in which this module's regular expressions and the library, of an older Unicode version, tell letters, digits and white space alike.
AGREED = re.compile(r"[\0-\u0557\u0900-\u0c5b\u0e00-\u208e\u20a0-\ua7cd\uac00-\ud7a3\uf900-\uffff\U0001f300-\U0001faff]*")
#: Longer words are encoded anew each time.
KEPT_WORD = 64


class ByteIds:
    """Ids of whole texts as the library gives them, without added special tokens, truncation or padding.

    specials: strings of special tokens inside a text count as those tokens, as is
    the library's default; else they are ordinary text. A byte-level vocabulary with
    the usual split and no normaliser encodes each word alone, so words are kept in
    two generations of at most CACHE_WORDS. Every other vocabulary, and texts with
    characters beyond AGREED or with a special token's string, go through the library whole.
    """

    def __init__(self, vocabulary: str, specials: bool = True):
        import json

        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(vocabulary)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.whole.encode_special_tokens = not specials
        made = json.loads(self.whole.to_str())
        split = made["pre_tokenizer"] or {}
        self.by_words = made["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and all(t["special"] for t in made["added_tokens"])
        added = [t["content"] for t in made["added_tokens"]] if specials else []
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self.words = regex.compile(_BYTE_WORDS)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _all(self, texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(x)}I", *x.ids) for x in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def ids_of(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not self.by_words or self.added.search(text) or not AGREED.fullmatch(text):
            return self._all([text])[0]
        found = self.words.findall(text)
        try:
            return b"".join(map(self.known.__getitem__, found))
        except KeyError:
            pass
        missing = list(dict.fromkeys(w for w in found if w not in self.known))
        fresh = {w: self.older[w] for w in missing if w in self.older}
        unseen = [w for w in missing if w not in fresh]
        for low in range(0, len(unseen), 10_000):
            some = unseen[low : low + 10_000]
            fresh.update(zip(some, self._all(some), strict=True))
        out = b"".join([self.known[w] if w in self.known else fresh[w] for w in found])
        kept = {w: x for w, x in fresh.items() if len(w) <= KEPT_WORD}
        if len(self.known) + len(kept) > CACHE_WORDS:
            self.older, self.known = self.known, {}
        if len(kept) <= CACHE_WORDS:
            self.known |= kept
        return out

    def count_of(self, text: str) -> int:
        return len(self.ids_of(text)) // 4

    def forget(self) -> None:
        self.known, self.older = {}, {}


class PieceIds:
    """The same for a sentencepiece model."""

    def __init__(self, model: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)

    def ids_of(self, text: str) -> bytes:
        ids = self.model.encode(text, num_threads=1)
        return struct.pack(f"<{len(ids)}I", *ids)

    def count_of(self, text: str) -> int:
        return len(self.model.encode(text, num_threads=1))

    def forget(self) -> None:
        """Nothing is kept."""


_encoders: dict[tuple[str, bool], ByteIds | PieceIds] = {}


def encoder_of(vocabulary: str, specials: bool = True) -> ByteIds | PieceIds:
    """By the file's ending: sentencepiece for .model, else tokenizers. One for each file and Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    key = vocabulary, specials
    if key not in _encoders:
        _encoders[key] = PieceIds(vocabulary) if vocabulary.endswith(".model") else ByteIds(vocabulary, specials)
    return _encoders[key]
