"""Joins to a unique side that stay even when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Keys that hold over a thousandth of all rows are fewer than this.
MOST_HOT = 1_000


def hot_keys(counts: DataFrame, keys: list[str], count: str, total: int, least: int = 100_000) -> DataFrame | None:
    """The keys of (keys, count) with more than a thousandth of `total` rows, and more than `least`, or None; so at most MOST_HOT, a bound for the broadcast."""
    limit = max(total / MOST_HOT, least)
    schema = counts.select(*keys).schema
    rows = counts.where(F.col(count) > limit).select(*keys).collect() if total > least else []
    return counts.sparkSession.createDataFrame(rows, schema) if rows else None


def lookup(left: DataFrame, right: DataFrame, on: list[str], hot: DataFrame | None, spread: Column) -> DataFrame:
    """Left join to `right`, which is unique by `on`.

    The rows of `right` for hot keys are broadcast; the others meet by a
    shuffle, in which left rows with hot keys are spread by `spread` instead of
    meeting in one task. Null keys find nothing.
    """
    if hot is None:
        return left.join(right, on, "left")
    values = [c for c in right.columns if c not in on]
    hot = F.broadcast(hot.select(*on))
    few = right.join(hot, on, "left_semi").select(*on, F.struct(F.lit(1).alias("__hit"), *values).alias("__few"))
    rest = right.join(hot, on, "left_anti").select(*on, F.lit(0).cast("bigint").alias("__salt"), F.struct(F.lit(1).alias("__hit"), *values).alias("__rest"))
    known = left.join(F.broadcast(few), on, "left")
    known = known.withColumn("__salt", F.when(F.col("__few").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(65_536))).cast("bigint"))
    found = known.join(rest, [*on, "__salt"], "left")
    return found.select(*left.columns, *(F.coalesce(F.col("__few")[v], F.col("__rest")[v]).alias(v) for v in values))
