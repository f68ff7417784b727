"""Join helpers: broadcast only with a proven size bound, cardinality checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def join_small(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str] | str,
    how: str = "inner",
    bounded: bool = False,
) -> DataFrame:
    """Equi-join a fact with a dimension-like side.

    ``bounded=True`` is for sides whose row count is bounded by construction
    (calendar days, nations, one row per scope): those are broadcast.  Every
    other side is planned as a shuffle join, and adaptive execution turns it
    into a broadcast only after measuring the materialised side at run time
    (``spark.sql.adaptive.autoBroadcastJoinThreshold``); a skewed key on the
    big side is split by the adaptive skew-join rule.
    """
    on = [on] if isinstance(on, str) else list(on)
    if bounded:
        small = F.broadcast(small)
    return big.join(small, on=on, how=how)


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Values of ``keys`` that occur more than once; empty when valid."""
    return df.groupBy(*keys).count().where(F.col("count") > 1)


def assert_unique(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """``df``, failing at run time with the key named if ``keys`` repeat.

    No job of its own: rows are numbered within their key, on the partitioning
    that a join on the keys needs anyway, and a second row raises.
    """
    again = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys)) > 1
    named = F.concat_ws(", ", *[F.concat(F.lit(f"{k} "), F.coalesce(F.col(k).cast("string"), F.lit("NULL"))) for k in keys])
    error = F.raise_error(F.concat(F.lit(f"{label}: "), named, F.lit(" occurs more than once")))
    return df.withColumn("_again", again).where(F.when(F.col("_again"), error.cast("boolean")).otherwise(F.lit(True))).drop("_again")
