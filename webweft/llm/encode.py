"""Token ids of whole texts, by white-space chunks and words that are encoded once and kept.

The vocabulary ``word_bpe_49k.json`` drops white space before the merges, and none of its
normalizer's steps looks across white space. A text's ids are therefore the ids of its
chunks, one after the other; a chunk's are those of its words. What was seen before needs
one dictionary look-up, and only new words reach the merges.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable
from functools import lru_cache

import regex

#: Chunks and words that are kept per Python worker; further ones are encoded each time.
KEPT_CHUNKS = 500_000
KEPT_WORDS = 500_000
#: Longer ones are not kept.
KEPT_LENGTH = 48

#: Characters that ``str.split`` treats as white space but Unicode's White_Space does not.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_WHITE = re.compile("[\t-\r \x85\xa0  -     　]+")


def chunks_of(text: str) -> list[str]:
    """The maximal runs without Unicode white space."""
    if _SEPARATORS.search(text):
        return [c for c in _WHITE.split(text) if c]
    return text.split()


#: Printable ASCII, and Latin and Cyrillic letters that are composed already, don't compose with each other, and have had
#: one lower-case form in every version of Unicode (a dotted capital I has two characters).
_SETTLED = re.compile("[ -~À-ÖØ-öø-įı-ſЀ-џ]+").fullmatch

#: Fixed value: the one normalizer whose steps :class:`WordSplitter` knows not to look across white space.
NORMALIZER = ["NFC", "Replace", "Lowercase"]


class WordSplitter:
    """What a vocabulary file with word ends does before the merges.

    Printable ASCII and settled letters are split here. For all else the library's own normalizer and splitter are asked,
    whose Unicode version is not that of Python's tables.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        steps = self.spec["normalizer"] or {}
        if [n["type"] for n in steps.get("normalizers", [steps])] != NORMALIZER:
            raise ValueError(f"{path} does not normalize texts as {', '.join(NORMALIZER)}")
        library = Tokenizer.from_file(path)
        self._normalized, self._split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.special = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        self.most_id = max([*self.spec["model"]["vocab"].values(), *self.special.values()])
        split = next(p for p in self.spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._words = regex.compile(split["pattern"]["Regex"]).findall
        self._marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        # Bytes that print stand for themselves, the others take the code points from 256 on, in order.
        plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        self._symbols = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}

    def words(self, part: str) -> list[str]:
        """The words of a part of a chunk, each as the printable characters of its bytes."""
        if not _SETTLED(part):
            return [symbols for symbols, _ in self._split(self._normalized(part))]
        part = part.lower()
        words = [part] if part.isalpha() else self._words(part)
        return words if part.isascii() else [w.encode("utf-8").decode("latin-1").translate(self._symbols) for w in words]

    def parts(self, chunk: str) -> list[str]:
        return [p for p in self._marks.split(chunk) if p] if self._marks and "<|" in chunk else [chunk]


class ChunkEncoder:
    """``ids_bytes(text)``: the ids of a whole text as little-endian unsigned 32-bit integers."""

    def __init__(self, splitter: WordSplitter, merge: Callable[[str], list[int]]):
        """``merge`` gives the ids of one word, which comes as byte symbols."""
        self._split, self._merge, self.most_id = splitter, merge, splitter.most_id
        self._chunks: dict[str, bytes] = {}
        self._words: dict[str, bytes] = {}

    def ids_bytes(self, text: str | None) -> bytes:
        if not text:
            return b""
        chunks = chunks_of(text)
        try:
            return b"".join(map(self._chunks.__getitem__, chunks))
        except KeyError:
            kept, new = self._chunks.get, self._new_chunk
            return b"".join([b if (b := kept(c)) is not None else new(c) for c in chunks])

    def _new_chunk(self, chunk: str) -> bytes:
        split, kept, new = self._split, self._words.get, self._new_word
        if "<|" in chunk:
            out = []
            for part in split.parts(chunk):
                if part in split.special:
                    out.append(struct.pack("<I", split.special[part]))
                else:
                    out += [kept(w) or new(w) for w in split.words(part)]
        else:
            out = [kept(w) or new(w) for w in split.words(chunk)]
        found = out[0] if len(out) == 1 else b"".join(out)
        if len(chunk) <= KEPT_LENGTH and len(self._chunks) < KEPT_CHUNKS:
            self._chunks[chunk] = found
        return found

    def _new_word(self, word: str) -> bytes:
        ids = self._merge(word)
        found = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= KEPT_LENGTH and len(self._words) < KEPT_WORDS:
            self._words[word] = found
        return found


@lru_cache(1)
def library_encoder(path: str) -> ChunkEncoder:
    """A :class:`ChunkEncoder` whose merges are the tokenizers library's. A Python worker keeps it
    from task to task, with the chunks and words it knows."""
    from tokenizers import Tokenizer

    tokenize = Tokenizer.from_file(path).model.tokenize
    return ChunkEncoder(WordSplitter(path), lambda word: [t.id for t in tokenize(word)])
