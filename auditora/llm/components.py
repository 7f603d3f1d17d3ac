"""Connected components of an edge table by repeated contraction.

In each round every node moves to the neighbour (or itself) that comes first in an order by degree,
then by a hash that changes every round, and the edges are renamed and reduced: stars vanish in
one round, chains by a constant factor, so rounds grow with the logarithm of the nodes whatever the
shape of the graph.  Nothing but emptiness reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled


def components(edges: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(node, comp) for every node of the edges (a, b), and of ``start`` (node, comp) from earlier calls.

    ``comp`` is one of the component's nodes.  With ``start``, edges join its components.
    """
    if start is not None:
        a = start.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
        b = start.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
        edges = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    left = settled(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = left.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("comp", F.col("node"))
    if start is not None:
        labels = start.unionByName(labels.join(start.select("node"), "node", "left_anti"))
    turn = 0
    while not left.isEmpty():
        turn += 1
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        degree = both.groupBy("b").agg((-F.count(F.lit(1))).alias("d"))
        own = degree.select(F.col("b").alias("a"), F.struct("d", F.xxhash64("b", F.lit(turn)).alias("h"), F.col("b").alias("n")).alias("own"))
        near = both.join(own.select(F.col("a").alias("b"), F.col("own").alias("near")), "b")
        least = near.groupBy("a").agg(F.min("near").alias("near")).join(own, "a")
        moves = settled(least.select(F.col("a").alias("node"), F.least("near", "own")["n"].alias("to")).filter("node <> to"))
        ma = moves.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        mb = moves.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        left = left.join(ma, "a", "left").join(mb, "b", "left").select(F.coalesce("ta", "a").alias("a"), F.coalesce("tb", "b").alias("b"))
        left = settled(left.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        labels = labels.join(moves.select(F.col("node").alias("comp"), "to"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    return settled(labels)
