"""Connected components of a distributed edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scatterwave.llm.common import dealt_anew
from scatterwave.runtime import cut


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest node around it."""
    sym = _both(edges)
    low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return sym.filter("v > u").join(dealt_anew(low, "u"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them. Edges come with u > v."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(dealt_anew(low, "u"), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, bound: int | None = None, max_rounds: int = 60) -> DataFrame:
    """``edges``: ``u, v`` long, in any order, repeats and loops allowed. Returns ``node, component`` for every node of a link.

    ``component`` is the smallest node reachable. Each round is written to the shared folder, so its lineage stays
    short; only two numbers reach the driver. Rounds grow with the logarithm of the longest chain. A star's centre
    is a frequent key of the joins, which are equi-joins that Spark splits where they are skewed. ``bound``: a known
    bound of the edges.
    """
    now = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), bound)
    sign = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = sign(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        now = cut(_small(_large(now)), 2 * seen[0])
        then, seen = seen, sign(now)
        if then == seen:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
