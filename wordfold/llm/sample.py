"""Bounded samples drawn by a hash, the same on every run and however rows are dealt out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Different hashes of a group that are looked at for each one that is wanted.
SPARE = 8


def smallest_hashes(df: DataFrame, group: str, h: str, value: Column, n: int) -> DataFrame:
    """Of each value of ``group`` the ``n`` smallest different hashes ``h``, each with the least ``value`` (as ``value``) of its rows.

    A share of the hash range that holds about ``SPARE * n`` different hashes is set by an estimate of their number, so however
    large the table and however often a row repeats, a group is ranked on that many rows.  One number per group comes to the driver.
    Rows without a group are left out.
    """
    known = df.where(F.col(group).isNotNull())
    estimates = known.groupBy(group).agg(F.approx_count_distinct(h).alias("__n")).collect()
    shares = [F.lit(x) for r in estimates for x in (r[group], min(1.0, SPARE * n / max(r["__n"], 1)))]
    share = F.try_element_at(F.create_map(*shares), F.col(group)) if shares else F.lit(0.0)
    firsts = known.where(F.col(h) / 2.0**64 + 0.5 <= share).groupBy(group, h).agg(F.min(value).alias("value"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(h))
    return firsts.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")
