"""Near copies by similarity of word shingles, one document of each group kept.

At a Jaccard similarity of 0.8 about 10 of 64 bits of two SimHashes differ, too many for shards
made of the bits themselves. Shards are therefore the texts that agree in a band of minimum
hashes of their 5-word shingles, which all but :func:`missed` of the pairs of a similarity do
wherever their words were changed. In a shard a BK-tree over SimHashes finds who may be near,
and only the exact Jaccard similarity of the shingle sets makes a link.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, joined_apart, materialize, named, release
from .graph import components
from .simhash import SEED, BkTree, majority, sharded_links, shingle_hashes

#: Words of a shingle and similarity of near copies.
WORDS, SIMILARITY = 5, 0.8
#: Differing bits up to which SimHashes of sets of that similarity are looked for. Of a pair of 4 and
#: 5 shingles, the worst case, a bit differs with a chance of 3/16, so more differ with one in a million.
RADIUS = 28
#: Candidates agree in all of so many minimum hashes in one of so many bands; the first few bands
#: are searched alone, and the others only for what they have not joined.
BAND_ROWS, BANDS, FIRST_BANDS = 4, 24, 4
#: Fixed odd factors and masks, by which one hash of a shingle becomes BAND_ROWS * BANDS.
_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BAND_ROWS * BANDS, 1), np.uint64)
_FACTORS, _MASKS = _DRAWN[0] | np.uint64(1), _DRAWN[1]
#: Sets of a shard searched at once.
DENSE_ROWS = 512
#: Rows that a map holds results of at once.
MAP_ROWS = 256


def missed(similarity: float) -> float:
    """Share of the pairs of that Jaccard similarity that agree in no band."""
    return (1 - similarity**BAND_ROWS) ** BANDS


def shingle_set(raw: bytes) -> np.ndarray:
    """The different hashes of a text's shingles, rising."""
    return np.unique(shingle_hashes(raw, WORDS))


def band_hashes(shingles: np.ndarray) -> list[int]:
    """A signed 64-bit hash per band, of BAND_ROWS minimum hashes of the shingles."""
    least = np.full(BAND_ROWS * BANDS, np.iinfo(np.uint64).max)
    for a in range(0, len(shingles), 4096):
        x = (shingles[a : a + 4096] ^ _MASKS) * _FACTORS
        x ^= x >> np.uint64(32)
        least = np.minimum(least, (x * np.uint64(0x9E3779B97F4A7C15)).min(axis=1))
    rows = least.reshape(BANDS, BAND_ROWS)
    return [xxhash.xxh64_intdigest(r.tobytes(), k) - (1 << 63) for k, r in enumerate(rows)]


def jaccard_reaches(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two rising arrays of different values are of that similarity at least."""
    small, large = sorted((len(a), len(b)))
    if small < similarity * large:
        return False
    both = np.concatenate((a, b))
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common >= similarity * (small + large - common)


def packed(shingles: np.ndarray) -> bytes:
    """A set with its SimHash before it."""
    return majority(shingles).to_bytes(8, "little") + shingles.tobytes()


class NearSets:
    """Packed sets: a BK-tree over their SimHashes, and what lies under each."""

    def __init__(self):
        self.tree = BkTree()
        self.under: dict[int, list[tuple[bytes, np.ndarray]]] = {}

    def add(self, value: bytes) -> None:
        print_ = int.from_bytes(value[:8], "little")
        self.tree.add(print_)
        self.under.setdefault(print_, []).append((value, np.frombuffer(value, "<u8", offset=8)))

    def within(self, value: bytes, similarity: float, skip: Callable[[bytes], bool]) -> Iterator[bytes]:
        """Sets of that similarity, without those to ``skip`` at the time they are come to."""
        own = np.frombuffer(value, "<u8", offset=8)
        for print_ in self.tree.within(int.from_bytes(value[:8], "little"), RADIUS):
            for v, x in self.under[print_]:
                if not skip(v) and jaccard_reaches(own, x, similarity):
                    yield v


def local_set_links(values: list[bytes], similarity: float) -> list[tuple[bytes, bytes]]:
    """Links that join what is joined by pairs of the similarity: (value, root) per value but the roots."""
    index = NearSets()
    up: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while up[x] is not x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for value in values:
        up[value] = value
        for hit in index.within(value, similarity, lambda v, value=value: root(v) is root(value)):
            up[root(value)] = root(hit)
        index.add(value)
    return [(v, r) for v in up if (r := root(v)) is not v]


def _mapped(df: DataFrame, keep: list[str], schema: str, kinds: list[pa.DataType], made: Callable[[np.ndarray], tuple]) -> DataFrame:
    """``keep`` and what ``made`` gives for the shingle set of ``text``, a few rows at a time."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, MAP_ROWS):
                part = batch.slice(a, MAP_ROWS)
                rows = [made(shingle_set((t.as_py() or "").encode("utf-8"))) for t in part.column(len(keep))]
                new = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *new], [*keep, *names])

    kept = ", ".join(f"{c} long" for c in keep)
    return df.select(*keep, "text").mapInArrow(run, f"{kept}, {schema}")


def near_copy_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, text_key, n, group``: rows by id and text (``n`` equal ones), and their group.

    Texts are linked whose sets of 5-word shingles have a Jaccard similarity of ``similarity`` or
    more, if they agree in one of BANDS bands of minimum hashes; :func:`missed` says how many
    pairs don't. Equal texts are always linked, as are all without a word. Null ids are ids of
    their own, an empty table has no groups, other columns are not read.
    """
    texts = df.select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    digest = _mapped(texts, ["doc_id", "text_key"], "print binary, bands array<long>", [pa.binary(), pa.list_(pa.int64())], lambda s: (xxhash.xxh128_digest(s.tobytes(), SEED), band_hashes(s)))
    rows = materialize(digest, "signatures")
    # A number stands for each set wherever it is not itself needed.
    nodes = rows.groupBy("print").agg(F.min(F.struct("doc_id", "text_key", "bands")).alias("m")).select("print", "m.*")
    nodes = materialize(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    keyed = nodes.select("id", F.posexplode("bands").alias("band", "hash")).select("id", "band", F.xxhash64("band", "hash").alias("shard"))
    met = joined_apart(keyed, keyed.groupBy("shard").agg(F.count("*").alias("n")).filter("n > 1").select("shard"), "shard", "left_semi")
    met = materialize(met.select("id", "band", "shard"), "met")
    # Only sets that meet another are made again; one row of each set has the text. Always by a merge
    # join, so that what is shuffled grows with the input and not by a leap where a table gets large.
    asked = materialize(nodes.join(met.select("id").distinct(), "id", "left_semi").select(F.col("doc_id").alias("i"), F.col("text_key").alias("k"), "id"), "asked")
    found = texts.join(asked.hint("merge"), texts["doc_id"].eqNullSafe(F.col("i")) & (texts["text_key"] == F.col("k"))).select("id", "text").dropDuplicates(["id"])
    sets = materialize(_mapped(found, ["id"], "print binary", [pa.binary()], lambda s: (packed(s),)), "sets")

    def linked(keys: DataFrame) -> DataFrame:
        return sharded_links(keys, similarity, DENSE_ROWS, sets, local_set_links, NearSets, lambda p: p)

    first = linked(met.filter(F.col("band") < FIRST_BANDS).select("id", "shard"))
    roots = components(first)
    rest = met.filter(F.col("band") >= FIRST_BANDS).join(roots, F.col("id") == F.col("node"), "left").select("id", "shard", F.coalesce("root", "id").alias("root"))
    rest = materialize(rest, "rest")
    apart = rest.groupBy("shard").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("shard")
    more = linked(joined_apart(rest, apart, "shard", "left_semi").select("id", "shard"))
    joined = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))
    rooted = nodes.join(joined, nodes["id"] == joined["node"], "left").select("print", F.coalesce("root", "id").alias("group"))
    once = rows.groupBy("doc_id", "text_key").agg(F.count("*").alias("n"), F.min("print").alias("own"))
    groups = materialize(once.join(rooted, once["own"] == rooted["print"]).select("doc_id", "text_key", "n", "group"), "groups")
    for table in (rows, nodes, met, asked, sets, rest):
        release(table)
    return groups


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``df`` with one row of each group of near copies: the smallest id's, nulls last.

    Rows and columns stay as they are. Repeated rows are a group of their own and leave one; of
    rows equal in id and text but not elsewhere, any one stays. Rows without a word (null, empty,
    blank) are one group. An empty table gives an empty one.
    """
    groups = near_copy_groups(df, id_col, text_col, similarity)
    first = groups.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key", "n")).alias("f"))
    i, t, key, copies = (fresh_name(df, c) for c in ("_kept_id", "_kept_text", "_text_key", "_copies"))
    kept = first.select(F.col("f.doc_id").alias(i), F.col("f.text_key").alias(t), F.col("f.n").alias(copies))
    keyed = df.withColumn(key, F.xxhash64(named(text_col).cast("string")))
    joined = keyed.join(kept, named(id_col).cast("long").eqNullSafe(F.col(i)) & (F.col(key) == F.col(t)))
    one = joined.filter(F.col(copies) == 1).select(*map(named, df.columns))
    several = joined.filter(F.col(copies) > 1).dropDuplicates([id_col, key]).select(*map(named, df.columns))
    return one.unionByName(several)
