"""Connected components by star contraction: a union-find whose forest is a table.

Every round hangs each node below the least node it knows (large star, then small star),
so trees flatten and chains shorten by a constant factor. Each round is written to the
shared folder, so a lost executor costs at most one round. Minima are aggregated before
any row moves, and the join with them has two plain sides, which Spark splits when a node
is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from qaloom.lineage import written


def digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def components(edges: DataFrame, left: str, right: str, name: str = "components") -> DataFrame:
    """``node``, ``root`` for every node of an edge that is not its component's least node.

    Edges may repeat, point either way or be loops; null ends are no edge. No edges give no
    rows. Nodes may be of any type with an order.
    """
    stars = written(
        edges.where(F.col(left) != F.col(right))
        .select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"))
        .where("a is not null and b is not null")
        .distinct(),
        name,
    )
    before = digest(stars)
    while before[0]:
        both = stars.union(stars.select("b", "a"))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), name)
        large = written(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), name)
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), name)
        small = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = written(small.union(least.select("a", "m")).distinct(), name)
        after = digest(stars)
        if after == before:
            break
        before = after
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
