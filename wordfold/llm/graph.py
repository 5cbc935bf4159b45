"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordfold.storage import materialize


def _nearest(pairs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The pairs and the smallest partner of each left end, both stored so that a busy left end can be split."""
    pairs = materialize(pairs, name)
    return pairs, materialize(pairs.groupBy("u").agg(F.min("v").alias("m")), name + "-min")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (smallest node of the component) for every node that is not its own root.

    ``edges`` has the columns u and v.  Each round is stored in the shared folder, so a lost executor costs no earlier round.
    The number of rounds grows with the logarithm of the longest chain.
    """
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _state(edges)
    while before[0]:
        both, near = _nearest(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both")
        large = both.join(near, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        down, near = _nearest(large, "down")
        joined = down.join(near, "u")
        small = joined.select("u", F.col("m").alias("v")).unionByName(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = materialize(small.distinct(), "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
