"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into the phrases of an LZ78 dictionary: each phrase is the shortest run that
the dictionary doesn't hold yet. The phrase set is hashed, and its smallest hashes are the
fingerprint; two fingerprints estimate the share of phrases that two texts have in common,
which follows how well one compresses with the other's dictionary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions

#: Smallest hashes that a fingerprint keeps; up to that many phrases it is the whole set.
KEPT = 128
#: Characters that a bucket of neighbouring documents holds on average.
BUCKET_CHARS = 16_000_000
#: Buckets at most: their borders and first ids are what the driver gets and the tasks are sent (under
#: 10 MB). Beyond, buckets grow; a task sorts its bucket on disk and holds two documents of it.
MOST_BUCKETS = 100_000
#: Ids that the borders are drawn from, for each bucket.
SAMPLE_IDS = 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class _Powers:
    """Powers of a base and of its inverse modulo 2^64, as far as they have been needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                self.up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]))
                self.down = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, _INVERSE)]))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def phrase_ends(text: str, seen: set[str], ends: list[int], at: int, phrase: str) -> str:
    """Go on parsing: ``text`` begins at position ``at`` with ``phrase`` open. Adds the ends of
    new phrases to ``ends`` and the phrases to ``seen``; returns the phrase left open."""
    add, end = seen.add, ends.append
    for at, c in enumerate(text, at + 1):
        phrase += c
        if phrase not in seen:
            add(phrase)
            end(at)
            phrase = ""
    return phrase


def smallest_hashes(text: str, ends: list[int], kept: int = KEPT) -> np.ndarray:
    """The smallest 32-bit hashes of the phrases that end at ``ends``; an open rest is a phrase
    of the dictionary already and adds nothing. Equal texts give equal hashes."""
    if not ends:
        return np.empty(0, np.uint32)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    up, down = _POWERS.to(len(codes) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum((codes + np.uint64(1)) * up[: len(codes)], dtype=np.uint64)])
        b = np.array(ends)
        a = np.concatenate([[0], b[:-1]])
        h = (sums[b] - sums[a]) * down[a]  # a polynomial in the base, the same wherever it stands
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    return np.unique((h >> np.uint64(32)).astype(np.uint32))[:kept]


def likeness(a: np.ndarray, b: np.ndarray, kept: int = KEPT) -> float:
    """Estimated share of common phrases: of the smallest hashes of both together, the part that
    both hold. Exact up to ``kept`` phrases; two without phrases are alike, one is not."""
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    both = np.union1d(a, b)[:kept]
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(both))


def hex_of(hashes: np.ndarray) -> str:
    return hashes.astype(">u4").tobytes().hex()


def fingerprint(text: str | None) -> np.ndarray:
    """Fingerprint of one text; null counts as empty."""
    text, ends = text or "", []
    phrase_ends(text, set(), ends, 0, "")
    return smallest_hashes(text, ends)


class _Parsed:
    """A document's own fingerprint; its first half's parse is kept for the edited text."""

    def __init__(self, doc_id: int | None, text: str | None):
        self.doc_id, self.text = doc_id, text or ""
        self.n = len(self.text)
        self.head = self.n - self.n // 2
        seen: set[str] = set()
        ends: list[int] = []
        self.open = phrase_ends(self.text[: self.head], seen, ends, 0, "")
        self.head_ends = len(ends)
        phrase_ends(self.text[self.head :], seen, ends, self.head, self.open)
        self.hashes = smallest_hashes(self.text, ends)
        starts = [0, *ends]
        for k in range(self.head_ends, len(ends)):
            seen.discard(self.text[starts[k] : ends[k]])
        self.seen, self.ends = seen, ends[: self.head_ends]

    def edited(self, following: str) -> tuple[str, np.ndarray]:
        text = self.text[: self.head] + following[: self.n // 2]
        phrase_ends(text[self.head :], self.seen, self.ends, self.head, self.open)
        found = smallest_hashes(text, self.ends)
        self.seen = set()  # used up
        return text, found


def borders(ids: DataFrame, rows: int, buckets: int) -> list[int]:
    """Ids that part a table of ``rows`` rows into about ``buckets`` ranges of equal counts, from a
    sample of about SAMPLE_IDS ids a range that a hash of the id chooses."""
    if buckets < 2:
        return []
    whole = 1 << 62
    share = min(whole, -(-whole * SAMPLE_IDS * buckets // max(1, rows)))
    drawn = ids.filter(F.xxhash64("doc_id").bitwiseAND(F.lit(whole - 1)) < share).select("doc_id").distinct()
    found = np.sort(drawn.toArrow().column(0).to_numpy())
    return np.unique(found[[len(found) * i // buckets for i in range(1, buckets)]]).tolist() if len(found) else []


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_with_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Fingerprints of every whole text and of its edited text.

    In the edited text, the last floor(n / 2) of n code points give way to the first as many (or
    all) of the next document's: the next by ascending id, nulls first, rows of one id by text;
    after the last comes the first. Returns ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``. A null text counts as empty and has the empty
    fingerprint, which is alike to itself only. Repeated rows follow each other; the only row of
    a table is its own next; an empty table gives an empty result; other columns are not read.

    Documents are dealt into id ranges, so each task sees a run of neighbours in order, and texts
    are shuffled once. The driver gets a sample of ids and the first id of each of at most
    MOST_BUCKETS ranges only. Rows of a range's first id go to the range before it too, whose last
    document looks ahead at them. Ids are taken to tell documents apart: rows of one id follow
    each other in one task, however many they are.
    """
    spark = df.sparkSession
    docs = df.select(df[id_col].cast("long").alias("doc_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))
    if buckets is None:
        chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
        buckets = min(MOST_BUCKETS, max(4 * shuffle_partitions(spark), -(-chars // BUCKET_CHARS)))
    known = docs.select("doc_id").filter("doc_id is not null")
    cuts = np.array(borders(known, known.count(), buckets), np.int64)

    @F.pandas_udf("int")
    def bucket_of(ids):
        import pandas as pd

        known = ids.notna()
        rank = np.zeros(len(ids), np.int32)
        rank[known] = np.searchsorted(cuts, ids[known].to_numpy(np.int64), side="right")
        return pd.Series(rank)

    ranged = docs.withColumn("bucket", bucket_of("doc_id"))
    found = ranged.groupBy("bucket").agg(F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("nulls")).collect()
    if not found:
        return spark.createDataFrame([], RESULT)
    first = {r["bucket"]: None if r["nulls"] else r["least"] for r in found}
    order = sorted(first)
    look = spark.createDataFrame([(b, first[b], order[i - 1]) for i, b in enumerate(order)], "bucket int, first_id long, before int")
    both = ranged.join(F.broadcast(look), "bucket")  # a row per range
    own, ahead = F.struct("bucket", F.lit(0).alias("later")), F.struct(F.col("before").alias("bucket"), F.lit(1).alias("later"))
    both = both.withColumn("at", F.explode(F.when(F.col("doc_id").eqNullSafe(F.col("first_id")), F.array(own, ahead)).otherwise(F.array(own))))
    parts = max(shuffle_partitions(spark), -(-len(order) // 4))
    dealt = both.select("doc_id", "text", "at.bucket", "at.later").repartition(parts, "bucket").sortWithinPartitions("bucket", "later", "doc_id", "text")
    return dealt.mapInArrow(_neighbours, RESULT)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document with the one after it; a range ends with a row that is only looked ahead at."""
    before: _Parsed | None = None
    done = None
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            doc_id, text, bucket, later = (batch.column(k)[i].as_py() for k in range(4))
            if bucket == done:
                continue
            now = _Parsed(doc_id, text)
            if before is not None:
                edited, hashes = before.edited(now.text)
                digest = hashlib.sha256(edited.encode("utf-8")).hexdigest()
                rows.append((before.doc_id, before.n, digest, hex_of(before.hashes), hex_of(hashes), likeness(before.hashes, hashes), likeness(before.hashes, now.hashes)))
            if later:
                done, before = bucket, None
            else:
                before = now
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)
