"""Connected components of an edge table, by alternating star contractions.

Each round first links a node's larger neighbours to its smallest neighbour, then its smaller
ones. The number of rounds grows with the logarithm of the longest chain, each is two
aggregations with map-side minima and two joins that Spark may split where a node is hot, and
nothing but a count reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_apart, materialize, release

MOST_ROUNDS = 60
#: Tables of fewer edges are written by few tasks: each has little to do but to open a file.
FEW_EDGES, FEW_TASKS = 1_000_000, 8


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``u, v`` with u > v; the large star looks at all neighbours, the small one at smaller ones."""
    ways = edges.select("u", "v")
    if large:
        ways = ways.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = ways.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    linked = joined_apart(ways, least, "u")
    if large:
        linked = linked.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        linked = linked.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(least.select("u", F.col("low").alias("v")))
    return linked.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def _sign(edges: DataFrame):
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()


def components(edges: DataFrame) -> DataFrame:
    """``u, v`` rows of any comparable type to ``node, root``: root is the smallest of its component.

    Nodes without an edge don't appear. The result is a table of the shared folder.
    """
    edges = edges.filter("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialize(edges, "edges")
    sign = _sign(now)

    def written(edges: DataFrame) -> DataFrame:
        return materialize(edges.coalesce(FEW_TASKS) if sign[0] < FEW_EDGES else edges, "edges")

    for _ in range(MOST_ROUNDS):
        # What a large star (one row for each edge) leaves as it is has no chain of falling nodes; if each
        # node has one smaller neighbour besides, it is made of stars around their smallest nodes.
        wide = written(_star(now, True))
        if _sign(wide) == sign and now.select("u").distinct().count() == sign[0]:
            release(wide)
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        after = written(_star(wide, False).distinct())
        release(now)
        release(wide)
        now, sign = after, _sign(after)
    raise RuntimeError("the components did not settle")
