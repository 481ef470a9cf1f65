"""Exact top-k inner-product search by distributed histogram selection.

All candidates are scored against a block of queries, but no score is shuffled. Instead, each
task counts its scores in the bins of a histogram per query; the sums over all tasks say in
which bin the k-th largest score lies, and the next pass counts finer bins inside that one,
until a bin is a single score. A last pass keeps what reaches the k-th score, ties by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append, materialize, reread

#: Query vectors that are sent to the tasks at once: so many, and no more bytes than this.
BLOCK_QUERIES = 2048
BLOCK_BYTES = 8 << 20
#: Bins of a histogram.
BINS_LOG2 = 12
#: Scores that a task holds at once.
TILE = 1 << 22
HITS = "query_id long, rank int, vec_id long, score long"


def quantize(vectors: DataFrame, id_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """``vec_id, v``: floor(scale * x) of each component as a long, only vectors that take part.

    Vectors that are null or hold a null, NaN or infinite component don't, nor do those of a null
    id. A component whose product doesn't fit a long is an error when the table is read.
    """
    v = F.col("v0")
    picked = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vec_col].cast("array<double>").alias("v0"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    picked = picked.filter(F.col("vec_id").isNotNull() & v.isNotNull() & fine)
    floor = lambda x: F.when(F.abs(x) * scale < float(1 << 62), F.floor(x * scale).cast("long")).otherwise(F.raise_error(F.lit("a component is too large")).cast("long"))
    return picked.select("vec_id", F.transform(v, floor).alias("v"))


class _Scorer:
    """Integer inner products of a block of queries with candidates, in exact arithmetic."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, bound: int):
        # Every partial sum is an integer of at most `bound`: floats hold them exactly up to 2^24 and 2^53.
        self.kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
        self.ids, self.dims = ids, vectors.shape[1]
        self.vectors = np.ascontiguousarray(vectors.T.astype(self.kind))

    def tiles(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(candidate ids, scores candidates x queries) of candidates as long as the queries."""
        rows = max(1, TILE // max(1, len(self.ids)))
        for batch in batches:
            lists = batch.column(1)
            ends = np.asarray(lists.offsets)
            ids = batch.column(0).to_numpy()
            same = np.diff(ends) == self.dims
            if not same.any():
                continue
            flat = np.asarray(lists.values)[ends[0] : ends[-1]]
            if same.all():
                matrix = flat.reshape(len(ids), self.dims)
            else:
                matrix = flat[(ends[:-1][same] - ends[0])[:, None] + np.arange(self.dims)]
                ids = ids[same]
            for a in range(0, len(ids), rows):
                yield ids[a : a + rows], (matrix[a : a + rows].astype(self.kind) @ self.vectors).astype(np.int64)


def _histogram(scorer: _Scorer, k: int, low: np.ndarray, shift: int):
    """A pass: per query, how many candidates have a score in each bin of 2^shift above ``low``.

    Scores above the last bin count as of it. Bins below the one in which a task's own k-th
    score lies can't hold the overall k-th score, and are not sent.
    """
    top = (1 << BINS_LOG2) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(scorer.ids)
        counts: np.ndarray | None = None
        for ids, scores in scorer.tiles(batches):
            if counts is None:
                counts = np.zeros((n, top + 2), np.int64)
            bins = np.clip((scores - low) >> shift, -1, top) + 1
            bins[ids[:, None] == scorer.ids[None, :]] = 0  # not the query itself
            counts += np.bincount((bins + np.arange(n) * (top + 2)).ravel(), minlength=n * (top + 2)).reshape(n, -1)
        if counts is None:
            return
        from_top = counts[:, :0:-1].cumsum(axis=1)  # of the bins from the highest down, without "below"
        useful = np.concatenate([np.zeros((n, 1), np.int64), from_top[:, :-1]], axis=1) < k
        own = counts[:, :0:-1]
        q, j = np.nonzero(useful & (own > 0))
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(top - j, pa.int32()), pa.array(own[q, j], pa.int64())], ["q", "bin", "n"])

    return run


def _kth_scores(candidates: DataFrame, scorer: _Scorer, k: int, bound: int) -> np.ndarray:
    """Each query's k-th largest score, the lowest possible one if it has fewer candidates."""
    low = np.full(len(scorer.ids), -bound, np.int64)
    width = (2 * bound + 1).bit_length()  # every score is below low + 2^width
    while width > 0:
        shift = max(0, width - BINS_LOG2)
        rows = candidates.mapInArrow(_histogram(scorer, k, low, shift), "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        # A row per query: the highest bin with k scores in it and above. The driver gets as many rows as the block has queries.
        above = rows.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("bin", "n")), asc=False).alias("bins"))
        found = above.select("q", F.aggregate("bins", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0).alias("bin")), lambda acc, x: F.when(acc["seen"] >= k, acc).otherwise(F.struct((acc["seen"] + x["n"]).alias("seen"), x["bin"].alias("bin")))).alias("at"))
        for r in found.collect():
            if r["at"]["seen"] >= k:
                low[r["q"]] += r["at"]["bin"] << shift
        width = shift
    return low


def _reaching(scorer: _Scorer, k: int, least: np.ndarray):
    """Last pass: what has at least the k-th score; of a task's rows with that very score, its k
    smallest ids, as only they can be among the k overall."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tied: dict[int, np.ndarray] = {}
        for ids, scores in scorer.tiles(batches):
            c, q = np.nonzero((scores >= least) & (ids[:, None] != scorer.ids[None, :]))
            s = scores[c, q]
            more = s > least[q]
            yield _hits(scorer.ids[q[more]], ids[c[more]], s[more])
            for one in np.unique(q[~more]).tolist():
                mine = ids[c[~more & (q == one)]]
                tied[one] = np.sort(np.concatenate([tied.get(one, mine[:0]), mine]))[:k]
        for one, mine in tied.items():
            yield _hits(np.full(len(mine), scorer.ids[one]), mine, np.full(len(mine), least[one]))

    return run


def _hits(query: np.ndarray, vec: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (query, vec, score)], ["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best candidates of each query, all if fewer.

    Score: integer inner product of floor(scale * x); ties go to the smaller id; rows with the
    query's own id are no candidates of it. Vectors that :func:`quantize` leaves out take no
    part; vectors of another length than the query's are not comparable. Repeated candidate rows
    are candidates each; queries that share an id and vector are asked once. Empty tables give
    an empty result; other columns are not read. Empty vectors have score 0 with each other;
    products that don't fit a long are an error.

    Queries are taken in blocks of about BLOCK_QUERIES or BLOCK_BYTES, the one thing that is broadcast.
    Each block needs a few passes over the candidates (each refines the histograms by
    2^BINS_LOG2), and its results are added to one table in the shared folder, so a lost executor
    costs one pass of one block at most.
    """
    spark = vectors.sparkSession
    candidates = materialize(quantize(vectors, id_col, vec_col, scale), "candidates")
    asked = materialize(quantize(queries, id_col, vec_col, scale).dropDuplicates(), "queries")
    sizes = candidates.groupBy(F.size("v").alias("dims")).agg(F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, x: F.greatest(a, F.abs(x)))).alias("most")).collect()
    out = materialize(spark.createDataFrame([], HITS).coalesce(1), "hits")
    for r in sorted(sizes, key=lambda r: r["dims"]):
        dims, most = r["dims"], r["most"]
        same = asked.filter(F.size("v") == dims)
        peak = same.agg(F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, x: F.greatest(a, F.abs(x)))), F.count("*")).first()
        if not peak[1]:
            continue
        bound = max(1, dims * most * peak[0])
        if bound >= 1 << 61:
            raise ValueError("inner products of these vectors don't fit a long")
        blocks = max(-(-peak[1] // BLOCK_QUERIES), -(-peak[1] * dims * 8 // BLOCK_BYTES))
        # Blocks of ids by hash: about equally large, and none needs more than a filter to be read.
        for b in range(blocks):
            block = same.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow()
            if not block.num_rows:
                continue
            scorer = _Scorer(block.column("vec_id").to_numpy(), np.array(block.column("v").to_pylist(), np.int64).reshape(block.num_rows, dims), bound)
            least = _kth_scores(candidates, scorer, k, bound)
            hits = candidates.mapInArrow(_reaching(scorer, k, least), "query_id long, vec_id long, score long")
            append(_ranked(hits, k), out)
    return reread(out)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    """Rank 1 to k: each query has fewer than k rows above its k-th score, and k tied ones a task."""
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
