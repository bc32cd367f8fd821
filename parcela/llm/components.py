"""Connected components of an edge table by alternating large and small stars.

Every round links the neighbours of a node to the smallest of them; rounds go
on until nothing changes, which takes about the logarithm of the longest
path.  A round is a grouped minimum and a join on the node, both of which
Spark reduces or splits where one node has very many edges.  Each round's
edges are cut to the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcela.llm.common import cut


def _state(edges: DataFrame) -> tuple[int, int]:
    """Count and an order-free sum of hashes: equal for equal edge sets."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b): the label is its component's smallest node.

    Edges with a null end and loops tell nothing and are left out; an empty
    table gives an empty one.
    """
    high, low = F.greatest("a", "b"), F.least("a", "b")
    now = cut(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(high.alias("a"), low.alias("b")).distinct())
    state = _state(now)
    while state[0]:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
        now = cut(small.distinct())
        after = _state(now)
        if after == state:
            break
        state = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionAll(
        now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
