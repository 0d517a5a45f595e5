"""Connected components of an edge table, by alternating stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_weighed

ROUNDS = 60


def state_of(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """edges (a, b), in either direction, repeated or not, to (node, root): the least node that each node is connected with.

    Every node links its larger neighbours to the least one it knows (large star), then its
    smaller ones (small star), until nothing changes; rows never outnumber the edges by more
    than the nodes. Each round is cut off by a checkpoint; nodes with very many neighbours are joined by a
    broadcast. Edges with a null and loops are left out; no edges give no rows. Raises RuntimeError if
    the last round still changed something (the number of rounds grows with the logarithm of the longest path).
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = state_of(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")))
        larger = join_weighed(edges.select(F.col("b").alias("a"), F.col("a").alias("v")), least, ["a"], "n").select(F.col("v").alias("a"), F.col("m").alias("b"))
        edges = larger.where("a <> b").distinct()
        # A node's links to smaller ones, of which it has as many as it has rows; each of them goes to the least.
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        smaller = edges.join(least, ["a"])
        linked = smaller.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(smaller.select("a", F.col("m").alias("b")))
        edges = cut(linked.where("a <> b").distinct())
        now = state_of(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
