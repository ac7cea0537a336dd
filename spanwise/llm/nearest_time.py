"""Pairing records of two tables by nearest time: expanding-ring joins.

A left time looks first into its own fine bucket and the two beside it. Any
right time outside those three lies at least the distance to their outer edges
away, so a match no farther than that is the nearest and is accepted; the rest
go on to buckets twice as wide, until a bucket spans the tolerance.

Entities are cut into slots of time far longer than the tolerance; right times
near a slot's edge are repeated in the neighbouring slot. Both sides are
shuffled once by (entity, slot), every ring reuses that partitioning, and no
entity, however large, meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanwise.functions.text import plain
from spanwise.session import cut

#: Ring joins on (entity, slot, bucket) may use a partitioning by (entity, slot).
_CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"


_ENDS = {True: "9223372036854775807L", False: "(-9223372036854775807L - 1L)"}


def _floor(t: str, width: int) -> Column:
    """Bucket of a whole-number time, exact, rounded down and safe at both ends of 64 bits."""
    return F.expr(f"({t} div {width}L) - if({t} % {width}L < 0, 1L, 0L)")


def _shifted(t: str, by: int) -> str:
    """t + by, held at the ends of 64 bits."""
    return f"coalesce(try_add({t}, {by}L), {_ENDS[by > 0]})"


def _times(df: DataFrame, entity: str, time: str, key: str) -> DataFrame:
    t = F.col(time).cast("bigint")
    return (
        df.select(plain(F.col(entity)).alias("entity"), t.alias("t"), F.col(key).cast("bigint").alias("id"))
        .where("entity is not null and t is not null and t <> 0 and id is not null")
    )


def nearest_in_time(left: DataFrame, right: DataFrame, entity: str, time: str, key: str, tolerance: int, first_width: int | None = None, slot_widths: int = 64) -> DataFrame:
    """(left_id, right_id, distance, rings): of each left row the right row of the same entity nearest in time.

    Entities are compared plainly; the tolerance is inclusive; ties go to the
    earlier right time, then to the smaller right id. Rows whose entity or key
    is null, or whose time is null or 0, pair with nothing; repeated left rows
    each have their pair; empty tables give no row. `rings` tells how many
    joins it took. Only the named columns are read, so others may clash.
    """
    if tolerance < 1:
        raise ValueError("a tolerance of at least 1")
    spark = left.sparkSession
    rows = _times(left, entity, time, key)
    slot = slot_widths * tolerance
    near = F.array_distinct(F.array(*(_floor(_shifted("t", d) if d else "t", slot) for d in (-tolerance, 0, tolerance))))
    # Copies shrink to one row for each time before anything is paired.
    rights = _times(right, entity, time, key).groupBy("entity", "t").agg(F.min("id").alias("r_id"))
    rights = rights.select("entity", F.explode(near).alias("slot"), F.col("t").alias("r_t"), "r_id")
    state = rows.select("entity", "t").distinct().select("entity", _floor("t", slot).alias("slot"), "t")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rights, state = (x.repartition(n, "entity", "slot") for x in (rights, state))
    state = state.select("*", F.lit(None).cast("struct<distance:bigint,r_t:bigint,r_id:bigint>").alias("best"), F.lit(0).alias("rings"), F.lit(False).alias("done"))

    # The bucket is worked out in the join itself, so that all rings read one shuffle of the right side.
    same = (F.col("l.entity") == F.col("r.entity")) & (F.col("l.slot") == F.col("r.slot"))
    width, ring, last = first_width or -(-tolerance // 4), 0, False
    while not last:
        last, ring = width >= tolerance, ring + 1
        here = _floor("t", width)
        asked = state.select("*", F.explode_outer(F.when(~F.col("done"), F.array(F.try_subtract(here, F.lit(1)), here, F.try_add(here, F.lit(1))))).alias("bucket"))
        gap = F.abs(F.col("r_t") - F.col("t"))
        match = F.when(gap <= tolerance, F.struct(gap.alias("distance"), F.col("r_t"), F.col("r_id")))
        state = (
            asked.alias("l").join(rights.alias("r"), same & (F.col("l.bucket") == _floor("r_t", width)), "left")
            .groupBy("l.entity", "l.slot", "t")
            .agg(F.first("best").alias("held"), F.min(match).alias("seen"), F.first("done").alias("done"), F.first("rings").alias("rings"))
        )
        into = F.expr(f"pmod(t, {width}L)")
        edge = F.least(into + width, 2 * width - into)
        proven = F.coalesce(F.col("seen.distance") <= edge, F.lit(False)) | F.lit(last)
        state = state.select(
            "entity", "slot", "t",
            F.when(F.col("done"), F.col("held")).otherwise(F.col("seen")).alias("best"),
            F.when(F.col("done"), F.col("rings")).otherwise(ring).alias("rings"),
            (F.col("done") | proven).alias("done"),
        )
        width *= 2
    pairs = state.where("best is not null").select("entity", "t", F.col("best.r_id").alias("right_id"), F.col("best.distance").alias("distance"), "rings")

    before = spark.conf.get(_CO_PARTITION, "true")
    spark.conf.set(_CO_PARTITION, "false")  # holds while the rings run
    try:
        pairs = cut(pairs)
    finally:
        spark.conf.set(_CO_PARTITION, before)
    return rows.withColumnRenamed("id", "left_id").join(pairs, ["entity", "t"]).select("left_id", "right_id", "distance", "rings")
