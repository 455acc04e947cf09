"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

#: Rounds after which something is wrong; components halve their depth in each.
MOST_ROUNDS = 60


def _stars(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For each u: its least neighbour m, paired with u's neighbours (rows: u, v, m); and the table of least neighbours.

    The least neighbours are written, so that both sides of the join are plain exchanges: then Spark can split the
    neighbours of one node among tasks.
    """
    least = written(pairs.groupBy("u").agg(F.min("v").alias("m")), "least")
    return pairs.join(least, "u"), least


def components(edges: DataFrame) -> DataFrame:
    """For an edge table (u, v) of longs: (node, root) with the least node of each component, for every node with an edge.

    A round needs two aggregations and two equi-joins; nodes with very many neighbours are pre-aggregated before the
    shuffle, and the joins have no aggregation on their key around them, so skewed partitions can be split. The tables
    of a round are deleted after the next.
    """
    now = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = written(now, "components")
    before = None
    for _ in range(MOST_ROUNDS):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
        before = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        stars, one = _stars(both)
        large = stars.filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small, two = _stars(large)
        later = small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(small.select("u", F.col("m").alias("v"))).distinct()
        later = written(later, "components")
        discard(now, one, two)
        now = later
    raise RuntimeError(f"components have not settled in {MOST_ROUNDS} rounds")
