"""Joining small results back to big tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ONE_ROW_KEY = "_one"


def attach_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row. One row, so the broadcast is bounded."""
    keyed = row.withColumn(ONE_ROW_KEY, F.lit(1))
    return df.withColumn(ONE_ROW_KEY, F.lit(1)).join(F.broadcast(keyed), ONE_ROW_KEY).drop(ONE_ROW_KEY)


def match(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join in which null keys are equal."""
    other = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    condition = None
    for c in on:
        same = left[c].eqNullSafe(other[f"_r_{c}"])
        condition = same if condition is None else condition & same
    return left.join(other, condition, how).drop(*[f"_r_{c}" for c in on])


def attach_groups(df: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Add per-group aggregates to the rows of the group. No hint: Spark broadcasts the side when
    its measured size allows it and splits skewed keys when not."""
    return attach_row(df, stats) if not keys else match(df, stats, keys, "left")


def rows_per_group(df: DataFrame, keys: list[str]) -> int:
    """Size of the biggest group (partial counts, one number comes back)."""
    if not keys:
        return df.count()
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def keys_repeat(df: DataFrame, keys: list[str]) -> bool:
    """Do two rows share a key? Only the keys are shuffled."""
    return not df.groupBy(*keys).count().where("count > 1").isEmpty()
