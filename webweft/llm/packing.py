"""Packing documents into sequences of a fixed number of tokens.

Two packers, over pieces of at most ``capacity`` tokens. Only longer documents are cut, so
no token is lost:

* :func:`pack_sum_of_squares` places each piece where the sum of the squared counts of open
  sequences per residual gap becomes smallest;
* :func:`pack_best_fit_decreasing` takes pieces by falling length and finds the smallest
  residual that holds a piece in a segment tree over residuals.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions, tokenizer_path
from .encode import library_encoder

#: Tokens of a sequence.
CAPACITY = 2048
#: Id that ends each document.
END_ID = 0
#: Pieces that one packing task gets on average; each such group leaves about one open sequence.
GROUP_PIECES = 32_768


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, lengths in the order in which to place them.

    With N(g) open sequences of gap g, a piece of length s in a sequence of gap g >= s turns
    N(g) into N(g) - 1 and N(g - s) into N(g - s) + 1, which changes the sum of squares by
    2 (N(g - s) - N(g) + 1), or by 1 - 2 N(g) if it closes the sequence (g = s). The smallest
    change wins, of equal ones the smallest gap. A new sequence opens only if none holds the piece.
    """
    n = len(lengths)
    sequence, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    count = np.zeros(capacity + 1, np.int64)  # by gap; sequences without a gap are closed and count 0
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    opened = 0
    never = np.int64(1) << 40
    for i, s in enumerate(lengths.tolist()):
        held = count[s:]
        change = 2 * (count[: capacity + 1 - s] - held + 1)
        change[0] -= 1
        change[held == 0] = never
        best = int(change.argmin())
        if change[best] == never:
            at, gap = opened, capacity
            opened += 1
        else:
            gap = best + s
            at = open_at[gap].pop()
            count[gap] -= 1
        sequence[i], offset[i] = at, capacity - gap
        if rest := gap - s:
            open_at[rest].append(at)
            count[rest] += 1
    return sequence, offset


class ResidualTree:
    """Segment tree over residuals 0..capacity: which have an open sequence, smallest first."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.open_at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, residual: int, sequence: int) -> None:
        self.open_at[residual].append(sequence)
        i = residual + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return (residual, sequence) of the smallest residual >= ``least``."""
        count, i = self.count, least + self.size
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i *= 2
                if not count[i]:
                    i += 1
        residual = i - self.size
        while i:
            count[i] -= 1
            i >>= 1
        return residual, self.open_at[residual].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; longest first, equal lengths in the given order."""
    n = len(lengths)
    sequence, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    tree, opened = ResidualTree(capacity), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[i])
        found = tree.take(s)
        if found is None:
            residual, at = capacity, opened
            opened += 1
        else:
            residual, at = found
        sequence[i], offset[i] = at, capacity - residual
        if residual > s:
            tree.add(residual - s, at)
    return sequence, offset


def token_pieces(df: DataFrame, id_col: str, text_col: str, path: str, capacity: int, end_id: int) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document; a map without shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = None, np.uint32(end_id).tobytes()
        for batch in batches:
            encoder = encoder or library_encoder(path)
            doc, piece, start, length, crc = [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = encoder.ids_bytes(text.as_py()) + end
                for k, at in enumerate(range(0, len(raw) // 4, capacity)):
                    part = raw[4 * at : 4 * (at + capacity)]
                    doc.append(doc_id)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    picked = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_sum_of_squares(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """Pack all documents into sequences by the sum-of-squares rule.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, a row per piece.
    A null or empty text is one piece that holds the end id only; repeated rows are packed each;
    a null id stays null; an empty table gives none; other columns are not read.

    Ids never leave the task that made them. What is shuffled is a few numbers per piece,
    dealt into groups of ``group_pieces`` pieces by a hash of the whole row and, for repeated
    rows, of a number within its task, so no key can gather in one. The pieces are written to
    the shared folder first: the groups then stay the same when a lost task runs again.
    """
    spark = df.sparkSession
    path = path or tokenizer_path("word_bpe_49k.json")
    pieces = token_pieces(df, id_col, text_col, path, capacity, end_id)
    pieces = materialize(pieces.withColumn("_salt", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("_salt", "doc_id", "piece"), F.lit(groups)))
    # A full piece is a sequence of its own wherever it lands, so it is numbered without any packing task.
    full = dealt.filter(F.col("length") == capacity).drop("_group")
    full = full.withColumn("sequence_id", -F.col("_salt") - 1).withColumn("offset", F.lit(0).cast("long")).drop("_salt")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    parts = min(groups, max(shuffle_partitions(spark), groups // 4 + 1))
    rest = dealt.filter(F.col("length") < capacity).repartition(parts, "_group").sortWithinPartitions("_group", F.desc("length"), "_salt").drop("_salt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, table in grouped(batches, "_group"):
            sequence, offset = sum_of_squares(table.column("length").to_numpy(), capacity)
            out = table.select(names[:5]).append_column("sequence_id", pa.array(sequence + (group << 36))).append_column("offset", pa.array(offset))
            yield from out.to_batches()

    packed = rest.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return full.select(names).unionByName(packed)


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """Runs of equal ``key`` in a partition that is sorted by it, one in memory at a time."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if held and keys[a] != now:
                yield int(now), pa.Table.from_batches(held)
                held = []
            now = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield int(now), pa.Table.from_batches(held)


#: Tokens that a packing task of :func:`pack_best_fit_decreasing` holds at once.
BLOCK_TOKENS = 4_000_000
#: A sequence that is filled less is taken apart and packed again with the next block, once, and only
#: as long as what is kept for that is no more than this share of a block.
FILLED, KEPT_OVER = 0.98, 0.5

PACKED = "sequence_id long, n_tokens int, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, ids binary, position_ids binary"


def pack_best_fit_decreasing(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    pad_id: int = 0,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """Tokenize, pack by best fit decreasing, and return packed id matrices, a row per sequence.

    ``ids`` is a row of the id matrix: ``capacity`` little-endian unsigned 16-bit ids, filled
    up with ``pad_id`` after ``n_tokens``. ``cu_seqlens`` are the cumulative segment lengths,
    from 0 to ``n_tokens``; ``position_ids`` (same layout) start from 0 again at each segment.
    Segment k holds document ``doc_ids[k]`` from its token ``starts[k]`` on, so documents
    longer than ``capacity`` can be put together again from their pieces without loss.

    Each task packs the rows of its own partition in blocks of ``block_tokens``, so ids are
    never shuffled and a task holds one block and one text at most; some sequences left badly
    filled are opened again with the next block, the worst first, each piece once. Null and empty texts are one end id, repeated rows are packed each, a
    null id stays null, an empty table gives no row; other columns are not read.
    """
    path = path or tokenizer_path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 36
        encoder = library_encoder(path)
        end = np.array([end_id], np.uint16)
        if max(encoder.most_id, end_id, pad_id) > 65_535:
            raise ValueError("ids are kept in 16 bits, but the vocabulary has larger ones")
        held: list[tuple[int | None, int, np.ndarray, bool]] = []  # the last: kept over from the block before
        tokens = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, tokens, number
            lengths = np.array([len(p[2]) for p in held], np.int64)
            sequence, offset = best_fit_decreasing(lengths, capacity)
            order = np.lexsort((offset, sequence))
            cuts = np.flatnonzero(np.diff(sequence[order], prepend=-1, append=-1)).tolist()
            again, rows, room = [], [], 0 if last else int(KEPT_OVER * block_tokens)
            groups = [[held[i] for i in order[a:b].tolist()] for a, b in zip(cuts, cuts[1:], strict=False)]
            for own in sorted(groups, key=lambda g: sum(len(p[2]) for p in g)):
                cu = np.cumsum([0] + [len(p[2]) for p in own])
                if cu[-1] < FILLED * capacity and cu[-1] <= room and not any(p[3] for p in own):
                    again += [(*p[:3], True) for p in own]
                    room -= int(cu[-1])
                    continue
                ids, position = np.full(capacity, pad_id, "<u2"), np.zeros(capacity, "<u2")
                for (_, _, part, _), at in zip(own, cu.tolist(), strict=False):
                    ids[at : at + len(part)] = part
                    position[at : at + len(part)] = np.arange(len(part), dtype=np.uint16)
                rows.append((number, int(cu[-1]), [p[0] for p in own], [p[1] for p in own], cu.tolist(), ids.tobytes(), position.tobytes()))
                number += 1
                if len(rows) == 512:
                    yield packed_batch(rows)
                    rows = []
            if rows:
                yield packed_batch(rows)
            held, tokens = again, sum(len(p[2]) for p in again)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate([np.frombuffer(encoder.ids_bytes(text.as_py()), "<u4").astype(np.uint16), end])
                held += [(doc_id, at, ids[at : at + capacity], False) for at in range(0, len(ids), capacity)]
                tokens += len(ids)
                if tokens >= block_tokens:
                    yield from flush(False)
        if held:
            yield from flush(True)

    if capacity > 65_535:
        raise ValueError("positions are kept in 16 bits")
    picked = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    return picked.mapInArrow(run, PACKED)


def packed_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
    names = ["sequence_id", "n_tokens", "doc_ids", "starts", "cu_seqlens", "ids", "position_ids"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def write_packed(df: DataFrame, path: str) -> None:
    """Write packed sequences as Parquet files: fixed-width binary rows that map onto matrices.

    A folder that is there already is an error; no sequence gives files without rows.
    """
    df.write.mode("errorifexists").parquet(path)


def unpack(packed: DataFrame) -> DataFrame:
    """The pieces of packed sequences: ``doc_id, start, length, ids`` (16-bit ids), natively.

    Padding is left out; documents with a null id keep it; repeated rows give a piece each; no
    sequence gives no piece.
    """
    segments = packed.select("ids", F.posexplode("doc_ids").alias("k", "doc_id"), "starts", "cu_seqlens")
    at, end = F.col("cu_seqlens")[F.col("k")], F.col("cu_seqlens")[F.col("k") + 1]
    return segments.select("doc_id", F.col("starts")[F.col("k")].alias("start"), (end - at).cast("long").alias("length"), F.col("ids").substr(2 * at + 1, 2 * (end - at)).alias("ids"))
