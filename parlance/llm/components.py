"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, stored

#: Edges up to which tables of a row for each node are broadcast, and edges of a node from which it is a hub.
SMALL, HUB = 500_000, 100_000


def _with_least(edges: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """``edges`` with the least neighbour ``m`` of ``u``; ``n`` bounds the rows of ``least``.

    Edges of hubs, of which there is one for ``HUB`` edges at most, meet theirs by a
    broadcast; those of other nodes by a shuffle.
    """
    if n <= SMALL:
        return edges.join(F.broadcast(least), "u")
    hubs = stored(edges.groupBy("u").count().filter(F.col("count") >= HUB).select("u"), "hubs")
    some = edges.join(F.broadcast(hubs), "u", "left_semi").join(F.broadcast(least.join(F.broadcast(hubs), "u", "left_semi")), "u")
    return some.unionByName(edges.join(F.broadcast(hubs), "u", "left_anti").join(least, "u"))


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return _with_least(both, least, 2 * n).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = _with_least(down, least, n).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``edges`` (``u, v``): the smallest node it reaches.

    Alternating large-star and small-star steps; every round is written to the
    shared folder, the one before it is deleted, and rounds end when the edges no longer change, after about
    the logarithm of the longest path.  Self loops and repeated edges are
    allowed; an empty table gives no rows.
    """
    now = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    sign = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == sign or not seen[0]:
            break
        sign = seen
        before, large = now, stored(_large_star(now, seen[0]), "edges")
        now = stored(_small_star(large, seen[0]), "edges")
        discard(before)
        discard(large)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots).distinct()
