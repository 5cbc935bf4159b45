"""Positions in a global order without sorting everything in one task.

``row_number() over (order by key)`` moves the whole table to a single task.  Here the
table is cut into ranges at split points drawn from the keys, each range is numbered
on its own, and the sizes of the ranges before it are added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordfold.functions.text import let

#: Least and most split points; between them there is one for each ROWS_PER_RANGE rows.
SPLITS, MOST_SPLITS = 255, (1 << 16) - 1
ROWS_PER_RANGE = 1_000_000


def wanted_splits(keyed: DataFrame) -> Column:
    """The number of split points for the rows of a table."""
    by_rows = F.least(F.lit(MOST_SPLITS).cast("long"), F.floor(F.count(F.lit(1)) / ROWS_PER_RANGE))
    return keyed.agg(F.greatest(F.lit(SPLITS).cast("long"), by_rows)).scalar()


def split_points(keyed: DataFrame, splits: Column) -> DataFrame:
    """One row holding at most ``splits`` ordered keys.

    The key with the smallest second hash of every hash bucket is a uniform draw that
    depends on the data only, so a lost and recomputed task sees the same points.
    """
    return (
        keyed.groupBy(F.pmod(F.xxhash64("__k"), splits).alias("__h"))
        .agg(F.min(F.struct(F.xxhash64("__k", F.lit(17)).alias("h"), F.col("__k").alias("k"))).alias("m"))
        .agg(F.sort_array(F.collect_list("m.k")).alias("__points"))
    )


def _points_up_to(points: Column, key: Column) -> Column:
    """How many ordered points are not above the key, by halving."""
    steps = [1 << b for b in reversed(range(MOST_SPLITS.bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, s: F.when(F.coalesce(F.get(points, at + s - 1) <= key, F.lit(False)), at + s).otherwise(at),
    )


def global_rank(
    df: DataFrame, key: Column, by: Sequence[str] = (), name: str = "rank", total: str = "total", splits: int | None = None
) -> DataFrame:
    """Add the 0-based position of every row in key order, and the size of its group.

    ``key`` must be unique within a group for the result to be repeatable.
    """
    by = list(by)
    keyed = df.withColumn("__k", key)
    placed = (
        keyed.select("*", split_points(keyed, wanted_splits(keyed) if splits is None else F.lit(splits)).scalar().alias("__points"))
        .withColumn("__range", let(F.col("__k"), lambda k: _points_up_to(F.col("__points"), k)))
        .drop("__points")
    )
    sizes = placed.groupBy(*by, "__range").agg(F.count(F.lit(1)).alias("__n"))
    # at most MOST_SPLITS + 1 rows per group
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *by,
        "__range",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"),
        F.sum("__n").over(Window.partitionBy(*by)).alias(total),
    )
    inside = Window.partitionBy(*by, "__range").orderBy("__k")
    if not by:
        offsets = F.broadcast(offsets)
    return (
        placed.join(offsets, [*by, "__range"])
        .withColumn(name, (F.row_number().over(inside) - 1 + F.col("__offset")).cast("long"))
        .drop("__k", "__range", "__offset")
    )


def top_k(df: DataFrame, order: Sequence[Column], k: int, by: Sequence[str]) -> DataFrame:
    """The first k rows of every group; for a small k Spark trims each partition to k before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= k).drop("__rank")


#: Parts of a group in ``ranked_heads``; at most PARTS * k rows of a group meet in one task.
PARTS = 64


def ranked_heads(df: DataFrame, order: Sequence[Column], k: int, by: Sequence[str], name: str = "rank") -> DataFrame:
    """The first k rows of every group with their 0-based place, for any k and also when one group has most of the rows.

    A group is cut into parts by a hash of the row; the best k of each part are found first, and only those meet.
    ``order`` must be unique within a group for the result to be repeatable.
    """
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(PARTS))
    heads = top_k(df.withColumn("__part", part), order, k, [*by, "__part"]).drop("__part")
    ranked = heads.withColumn("__place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__place") <= k)
    return ranked.select(*[f"`{c}`" for c in df.columns], (F.col("__place") - 1).alias(name))
