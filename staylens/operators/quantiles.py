"""Exact quantiles per group from value counts and running totals.

``percentile`` holds a map of a group's values in one task.  Here equal values
are counted first, combined map-side.  Running totals have two levels, so a
group of any size is spread over tasks: within a bucket of neighbouring values
(a sixteenth of a factor of two), and over a group's buckets, of which there
are at most 69,000 whatever its size.  The value at a rank is the one whose
running total passes it; quantiles between two ranks are interpolated linearly,
as pandas and ``percentile`` do.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from staylens.operators.joins import join_small

_STEPS = 16  # buckets per factor of two
_ZERO = 17_300  # beyond the 1,075 factors of two between the smallest double and one


def _bucket(value: Column) -> Column:
    """A whole number that never falls as ``value`` grows."""
    size = F.floor(F.log2(F.abs(value)) * _STEPS) + _ZERO
    return F.when(value == 0, F.lit(0)).when(value > 0, size).otherwise(-size).cast("long")


def group_quantiles(df: DataFrame, by: Sequence[str], value: Column, points: Sequence[float], name: str = "_q") -> DataFrame:
    """One row per group with an array of its quantiles; NULL values don't count, groups of none are left out."""
    by = list(by)
    counts = df.select(*by, value.cast("double").alias("_v")).where(F.col("_v").isNotNull()).groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.withColumn("_b", _bucket(F.col("_v")))
    within = Window.partitionBy(*by, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    values = counts.withColumn("_in", F.sum("_c").over(within))
    buckets = values.groupBy(*by, "_b").agg(F.sum("_c").alias("_bc"))
    group = Window.partitionBy(*by)
    before = F.sum("_bc").over(group.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_bc")
    buckets = buckets.withColumns({"_before": before, "_n": F.sum("_bc").over(group)}).drop("_bc")
    ranked = join_small(values, buckets, on=[*by, "_b"], how="inner").withColumn("_to", F.col("_before") + F.col("_in"))

    def at(rank: Column) -> Column:
        return F.max(F.when((rank < F.col("_to")) & (rank >= F.col("_to") - F.col("_c")), F.col("_v")))

    def place(p: float) -> Column:
        return (F.col("_n") - 1) * F.lit(float(p))

    found = [x for i, p in enumerate(points) for x in (at(F.floor(place(p))).alias(f"_lo{i}"), at(F.ceil(place(p))).alias(f"_hi{i}"))]
    out = ranked.groupBy(*by).agg(F.max("_n").alias("_n"), *found)
    quantiles = []
    for i, p in enumerate(points):
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        between = (F.ceil(place(p)) - place(p)) * lo + (place(p) - F.floor(place(p))) * hi
        quantiles.append(F.when(lo == hi, lo).otherwise(between))
    return out.select(*by, F.array(*quantiles).alias(name))
