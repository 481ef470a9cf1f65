"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import tokenizer_path
from .encode import ChunkEncoder, WordSplitter

#: Rank of a pair that no merge joins.
NEVER = 1 << 60


def merge_symbols(symbols: list[int], ranks: dict[int, int], made: list[int]) -> list[int]:
    """Merge the leftmost pair of the lowest rank until no pair can be merged.

    ``ranks`` has a pair's rank under ``left << 32 | right``, ``made`` the symbol that each
    rank makes. Leaf ``i`` of the segment tree holds the rank of the pair that starts at
    symbol ``i``, an inner node the smaller of its children's ranks: the root has the lowest,
    going left on ties finds the leftmost, and a point update walks one path until nothing
    changes, so n symbols take O(n log n) steps at most.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    rank = ranks.get
    size = 1 << (n - 2).bit_length()
    low = [NEVER] * (2 * size)
    low[size : size + n - 1] = [rank(a << 32 | b, NEVER) for a, b in zip(symbols, symbols[1:], strict=False)]
    for i in range(size - 1, 0, -1):
        low[i] = min(low[2 * i], low[2 * i + 1])
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive: list[int] = list(symbols)

    def put(i: int, value: int) -> None:
        i += size
        low[i] = value
        while i > 1:
            beside = low[i ^ 1]
            if beside < value:
                value = beside
            i >>= 1
            if low[i] == value:
                return
            low[i] = value

    while (want := low[1]) != NEVER:
        at = 1
        while at < size:
            at *= 2
            if low[at] != want:
                at += 1
        at -= size
        gone = after[at]
        mine = alive[at] = made[want]
        alive[gone] = -1
        follow = after[at] = after[gone]
        if follow < n:
            before[follow] = at
            put(gone, NEVER)
            put(at, rank(mine << 32 | alive[follow], NEVER))
        else:
            put(at, NEVER)
        left = before[at]
        if left >= 0:
            put(left, rank(alive[left] << 32 | mine, NEVER))
    return [s for s in alive if s >= 0]


class WordBpe:
    """Encoder and decoder for a vocabulary file with word ends (``word_bpe_49k.json``)."""

    def __init__(self, path: str):
        self.splitter = WordSplitter(path)
        model = self.splitter.spec["model"]
        ids, self.end = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        self.ids = ids
        self.ranks = {ids[a] << 32 | ids[b]: i for i, (a, b) in enumerate(pairs)}
        self.made = [ids[a + b] for a, b in pairs]
        names = {i: t for t, i in (ids | self.splitter.special).items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]

    def word(self, symbols: str) -> list[int]:
        """Ids of one word, given as byte symbols; symbols that have no id are left out."""
        get = self.ids.get
        first = [get(s) for s in symbols[:-1]] + [get(symbols[-1] + self.end)]
        return merge_symbols([i for i in first if i is not None], self.ranks, self.made)

    def encoder(self) -> ChunkEncoder:
        return ChunkEncoder(self.splitter, self.word)

    def decode(self, ids) -> str:
        """The file names no decoder, so tokens are joined by one space, special ones too."""
        return " ".join(map(self.names.__getitem__, ids))


@lru_cache(1)
def kept_encoder(path: str) -> tuple[WordBpe, ChunkEncoder]:
    """The vocabulary of a file and an encoder, which a Python worker keeps from task to task."""
    bpe = WordBpe(path)
    return bpe, bpe.encoder()


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_decode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Encode every whole text, decode it again, and return both sides' digests.

    Returns ``doc_id, n_tokens, ids_sha256, decoded_sha256``; with ``keep_ids`` also
    ``ids`` (little-endian unsigned 32-bit) and ``decoded``. A null text counts as empty: no
    ids, and the digests of nothing. Repeated rows give repeated rows, an empty table an empty
    one; other columns are not read. A map without shuffle: a lost task is computed again alone.
    """
    path = path or tokenizer_path("word_bpe_49k.json")
    schema = SCHEMA + (", ids binary, decoded string" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bpe, encoder = kept_encoder(path)
            n, ids_sha, text_sha, ids_out, text_out = [], [], [], [], []
            for text in batch.column(1):
                raw = encoder.ids_bytes(text.as_py())
                decoded = bpe.decode(np.frombuffer(raw, dtype="<u4").tolist())
                n.append(len(raw) // 4)
                ids_sha.append(hashlib.sha256(raw).hexdigest())
                text_sha.append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
                if keep_ids:
                    ids_out.append(raw)
                    text_out.append(decoded)
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                cols += [pa.array(ids_out, pa.binary()), pa.array(text_out, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)

    picked = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    return picked.mapInArrow(run, schema)
