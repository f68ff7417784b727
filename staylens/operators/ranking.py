"""Global row numbers without a single-partition window.

``orderBy`` range-partitions the rows (boundaries sampled, so a popular
value is split across tasks) and sorts each partition.  A row's position is
the number of rows in earlier partitions plus its position inside its own
partition; ``monotonically_increasing_id`` carries (partition, position)
in its upper and lower bits.  The per-partition counts form a table with
one row per partition, a proven bound, which is the only thing broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from staylens.session import cut_lineage

_LOW_BITS = (1 << 33) - 1


def global_row_number(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``df`` plus ``name`` = 1..n in ``order`` (which must be a total order).
    """
    # read by the counts and by the ranked rows: written once, so its shuffle is coalesced and nothing stays cached
    tagged = cut_lineage(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()), "ranked")
    part = F.shiftrightunsigned(F.col("_mid"), 33)
    counts = tagged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn(
        "_off",
        F.coalesce(
            F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ),
    ).select("_part", "_off")
    ranked = tagged.join(F.broadcast(offsets), part == F.col("_part"), "inner")
    position = F.col("_off") + F.col("_mid").bitwiseAND(F.lit(_LOW_BITS)) + 1
    return ranked.withColumn(name, position.cast("bigint")).drop("_mid", "_part", "_off")
