"""SimHash fingerprints, and near duplicates among them by sharded BK-trees.

Fingerprints are dealt into shards so that any two within the radius meet in at least one:
the bits are cut into bands, and a shard holds the fingerprints that agree in a certain choice
of bands. In a shard a BK-tree (children keyed by integer Hamming distance to their parent)
finds the neighbours; only edges within the radius of the distance are followed. A shard's
tree travels nowhere: it is built by the task that its fingerprints are shuffled to, since the
trees of all shards together grow with the corpus and have no bound for a broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_apart, materialize, release, shuffle_partitions
from .graph import components
from .packing import grouped

SEED = 42
#: Fingerprints of a shard that one task searches at once; larger shards are split.
SHARD_ROWS = 4096
_U64 = (1 << 64) - 1


class BkTree:
    """BK-tree over distinct integers under the Hamming distance."""

    def __init__(self):
        self.root: int | None = None
        self.children: dict[int, dict[int, int]] = {}

    def add(self, value: int) -> None:
        children = self.children
        if self.root is None:
            self.root = value
            children[value] = {}
            return
        at = self.root
        while d := (at ^ value).bit_count():
            below = children[at]
            if d not in below:
                below[d] = value
                children[value] = {}
                return
            at = below[d]

    def within(self, value: int, radius: int, skip: Callable[[int], bool] | None = None) -> list[int]:
        """Values within ``radius``, without those to ``skip``."""
        if self.root is None:
            return []
        found, stack, children = [], [self.root], self.children
        while stack:
            at = stack.pop()
            d = (at ^ value).bit_count()
            if d <= radius:
                found.append(at)
            below = children[at]
            if below:
                for edge, child in below.items():
                    if -radius <= edge - d <= radius:
                        stack.append(child)
        return [v for v in found if not skip(v)] if skip else found


def local_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that join what is joined within ``radius``: (value, root) per value but the roots.

    As many as there are values at most, however many pairs are near; none is lost for
    connectivity.
    """
    tree, up = BkTree(), {}

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x in values:
        if x in up:
            continue
        up[x] = x
        for y in tree.within(x, radius):
            a, b = root(x), root(y)
            if a != b:
                up[max(a, b)] = min(a, b)
        tree.add(x)
    return [(x, r) for x in up if (r := root(x)) != x]


def majority(hashes: np.ndarray) -> int:
    """The fingerprint whose bits are set in over half of 64-bit hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 65_536):
        part = hashes[a : a + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def shingle_hashes(raw: bytes, words: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of the word shingles of UTF-8 text, A-Z lowered, words parted by ASCII white space."""
    tokens = raw.lower().split()  # both touch ASCII only
    if not tokens:
        return np.empty(0, "<u8")
    hashed = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return np.array([hashed(b" ".join(tokens), seed)], "<u8")
    joined = memoryview(b" ".join(tokens))
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    a, b = starts[: len(tokens) - words + 1].tolist(), ends[words - 1 :].tolist()
    return np.fromiter([hashed(joined[i:j], seed) for i, j in zip(a, b, strict=True)], "<u8", len(a))


def fingerprints(df: DataFrame, text_col: str = "text", words: int = 4, seed: int = SEED, out: str = "fingerprint") -> DataFrame:
    """``df``'s rows with the SimHash of their whole text as a long in column ``out``.

    A map without shuffle. Null, empty and all-blank texts have no shingle and fingerprint 0.
    """

    @F.pandas_udf("long")
    def simhash(texts):
        import pandas as pd

        return pd.Series([np.uint64(majority(shingle_hashes((t or "").encode("utf-8"), words, seed))).astype(np.int64) for t in texts], dtype="int64")

    return df.withColumn(out, simhash(F.col(text_col).cast("string")))


def _bits(value, low: int, width: int):
    return F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << width) - 1))


def band_keys(value: str, bands: int, chosen: int, salt: int = 0) -> list:
    """A shard key for each choice of ``chosen`` of ``bands`` bands of a 64-bit value."""
    cuts = [64 * i // bands for i in range(bands + 1)]
    col, keys = F.col(value), []
    for number, which in enumerate(combinations(range(bands), chosen)):
        parts = [_bits(col, cuts[i], cuts[i + 1] - cuts[i]) for i in which]
        keys.append(F.xxhash64(F.lit(salt), F.lit(number), *parts))
    return keys


def _whole(value: int | bytes) -> int:
    """A fingerprint, kept as a signed long or as bytes, as an unsigned integer."""
    return value & _U64 if isinstance(value, int) else int.from_bytes(value, "little")


def sharded_links(keys: DataFrame, radius: float, shard_rows: int = SHARD_ROWS, prints: DataFrame | None = None, local=local_links, index=BkTree, whole=_whole) -> DataFrame:
    """Links ``u, v`` whose components are those of all pairs within ``radius`` bits that share
    a shard. ``keys``: ``id`` (long), ``shard``; each pair once. ``prints`` has each id's
    fingerprint as binary ``print``, all different; without it the ids are the fingerprints.
    Other likenesses than bits come with a ``local`` linker, an ``index`` and a reader ``whole``
    of their own.

    Each shard gives one link per fingerprint at most. Shards of more than ``shard_rows`` are
    dealt into parts, each of which is searched alone; then what a shard's largest component
    doesn't yet hold is searched for in all of its parts, since links within one component add
    nothing to it.
    """
    spark = keys.sparkSession
    sizes = keys.groupBy("shard").agg(F.count("*").alias("n")).filter("n > 1")
    keyed = joined_apart(keys, sizes, "shard").withColumn("parts", F.ceil(F.col("n") / shard_rows).cast("int"))
    keyed = keyed.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).select("shard", "parts", "part", "id")
    keyed = materialize(keyed, "shards")

    def printed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("print", F.col("id")) if prints is None else rows.join(prints, "id")

    dealt = printed(keyed.withColumn("bucket", F.xxhash64("shard", "part")).select("bucket", "id"))
    dealt = dealt.repartition(shuffle_partitions(spark), "bucket").sortWithinPartitions("bucket")

    def pairs(found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["u", "v"])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list = []
        for _, table in grouped(batches, "bucket"):
            if table.num_rows > 1:
                own = {whole(p): i for p, i in zip(table.column("print").to_pylist(), table.column("id").to_pylist(), strict=True)}
                out += [(own[x], own[y]) for x, y in local(list(own), radius)]
            if len(out) > 50_000:
                yield pairs(out)
                out = []
        yield pairs(out)

    links = materialize(dealt.mapInArrow(within, "u long, v long").distinct(), "links")
    hot = keyed.filter("parts > 1")
    if hot.isEmpty():
        release(keyed)
        return links
    # Second search, in the parts of large shards only.
    roots = components(links)
    joined = hot.join(roots, hot["id"] == roots["node"], "left").select("shard", "parts", "part", "id", F.coalesce("root", "id").alias("root"))
    largest = joined.groupBy("shard", "root").agg(F.count("*").alias("n")).groupBy("shard").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    joined = joined_apart(joined, largest, "shard").withColumn("asks", F.col("root") != F.col("main"))
    trees = joined.select("shard", "part", "id", "root", F.lit(False).alias("asks"))
    asking = joined.filter("asks").select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "id", "root", F.lit(True).alias("asks"))
    both = printed(trees.unionByName(asking).withColumn("bucket", F.xxhash64("shard", "part")).select("bucket", "id", "root", "asks"))
    both = both.repartition(shuffle_partitions(spark), "bucket").sortWithinPartitions("bucket")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in grouped(batches, "bucket"):
            values, roots_, asks = (table.column(c).to_pylist() for c in ("print", "root", "asks"))
            if not any(asks):
                continue
            root_of = {whole(v): r for v, r in zip(values, roots_, strict=True)}
            tree, out = index(), {}
            for v, a in zip(values, asks, strict=True):
                if not a:
                    tree.add(whole(v))
            for v, a in zip(values, asks, strict=True):
                if a:
                    mine = root_of[whole(v)]
                    for y in tree.within(whole(v), radius, lambda y, mine=mine: root_of[y] == mine or (mine, root_of[y]) in out):
                        out[mine, root_of[y]] = None
            yield pairs(list(out))

    more = both.mapInArrow(across, "u long, v long").distinct()
    return roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more)


def distinct_links(values: DataFrame, radius: int, bands: int = 6, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links ``u, v`` among the distinct longs of column ``value`` whose components are those of
    all pairs within ``radius`` bits.

    Of ``bands`` bands at most ``radius`` can hold a differing bit, so two values within the
    radius agree in ``bands - radius`` bands at least and share a shard. (Two shard keys that
    collide only make one larger shard.)
    """
    keys = values.select(F.col("value").alias("id"), F.explode(F.array(*band_keys("value", bands, bands - radius))).alias("shard"))
    return sharded_links(keys, radius, shard_rows)


def bands_for(values: int, radius: int, shard_rows: int = SHARD_ROWS) -> int:
    """Bands with which ``values`` evenly spread fingerprints make shards of ``shard_rows`` at most:
    more bands make smaller shards, but more keys of each fingerprint."""
    bands = radius + 2
    while bands < 2 * radius + 2 and values >> (64 * (bands - radius) // bands) > shard_rows:
        bands += 1
    return bands


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 4,
    radius: int = 4,
    bands: int | None = None,
    seed: int = SEED,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of each row: 16 hex digits, and the smallest id
    that can be reached by links of ``radius`` or fewer differing bits, itself included.

    Copies share a fingerprint and are one node of the search. Null, empty and blank texts have
    fingerprint zero and are linked like any other; repeated rows stay; a null id gets a
    component like any other row's, null only if all of its ids are null; an empty table gives
    an empty result; other columns are not read. Null ids count as larger than all others.
    ``bands`` only decides on the cost (see :func:`bands_for`), never on the result.
    """
    picked = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    made = materialize(fingerprints(picked, "text", words, seed).select("doc_id", "fingerprint"), "fingerprints")
    nodes = made.groupBy(F.col("fingerprint").alias("value")).agg(F.min("doc_id").alias("least"))
    nodes = materialize(nodes, "nodes")
    bands = bands or bands_for(nodes.count(), radius)
    roots = components(distinct_links(nodes.select("value"), radius, bands, shard_rows))
    rooted = nodes.join(roots, nodes["value"] == roots["node"], "left").select("value", "least", F.coalesce("root", "value").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = rooted.join(ids, "root").select("value", "component_id")
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return made.join(labels, made["fingerprint"] == labels["value"]).select("doc_id", digits.alias("fingerprint"), "component_id")
