"""Connected components of an undirected graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import apart, cut


def _minima(pairs: DataFrame) -> DataFrame:
    """Smallest neighbour of each node: a partial aggregate, so a hub is reduced before the shuffle."""
    return pairs.groupBy("a").agg(F.min("b").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    joined = both.where("b > a").join(apart(_minima(both)), "a")
    return joined.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    joined = down.join(apart(_minima(down)), "a")
    linked = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionAll(joined.where("b = m").select("a", "b"))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]


def components(edges: DataFrame) -> DataFrame:
    """Columns ``a``, ``b`` (long, a link each way counts once) to ``node``, ``root``: the smallest node reachable.

    Every node of an edge appears once; nodes without edges don't appear. Loops are ignored. The rounds are few,
    about the logarithm of the longest chain; each ends in a reliable checkpoint, and no node's neighbours are
    gathered: minima come from partial aggregates, and a hub's rows are split by the adaptive skew join.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(edges)
    while state[0]:
        edges = cut(_small_star(_large_star(edges).distinct()).distinct())
        now = _state(edges)
        if now == state:
            break
        state = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
