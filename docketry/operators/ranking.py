"""Exact ranks and running totals within groups of any size, without sorting a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded_key(seed: int | str, *columns: Column | str) -> Column:
    """A 64-bit key that orders rows at random, alike in every run and on every cluster."""
    return F.xxhash64(F.lit(str(seed)), *columns)


def running(df: DataFrame, keys: Sequence[str], order: str, tie: str, weight: Column | None = None, bits: int = 10, upto: str | None = None) -> DataFrame:
    """df with rank (1 for the first row of a group) and before (sum of weight over the rows before; 0 for the first).

    A group is the rows of equal keys; nulls form a group. Rows are ordered by order, a 64-bit hash, then by tie. The
    upper bits of the hash cut each group into 2**bits slices that keep the order. Only counts and sums per slice are
    accumulated over a group; rows are numbered within their slice, so a group that holds a third of all rows is spread
    over as many tasks as any other rows. With upto, the name of a column that is constant in a group, only rows of
    rank at most upto are kept, and slices that begin beyond it are dropped before any sort. A null weight counts as 0.
    """
    weight = F.lit(0) if weight is None else F.coalesce(weight, F.lit(0))
    sliced = df.withColumn("_w", weight.cast("bigint")).withColumn("_slice", F.shiftright(F.col(order), 64 - bits))
    sums = sliced.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"), F.sum("_w").alias("_s"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_s0"))
    same = [sliced[k].eqNullSafe(offsets[k]) for k in (*keys, "_slice")]
    placed = sliced.join(offsets, same).drop(*[offsets[k] for k in (*keys, "_slice")])
    if upto:
        placed = placed.where(F.col("_n0") < F.col(upto))
    inside = Window.partitionBy(*keys, "_slice").orderBy(order, tie)
    out = placed.withColumn("rank", F.col("_n0") + F.row_number().over(inside))
    out = out.withColumn("before", F.col("_s0") + F.coalesce(F.sum("_w").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = out.drop("_w", "_slice", "_n0", "_s0")
    return out.where(F.col("rank") <= F.col(upto)) if upto else out
