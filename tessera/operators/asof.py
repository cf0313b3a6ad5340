"""Nearest as-of joins and interval joins, without cross joins.

The as-of join unions both sides and carries the last right row forward and the next one backward with two windows, so
it costs two sorts. Windows are partitioned by the keys and by time buckets much wider than the tolerance; right rows
near a bucket's edge are repeated in the next one, so a long sequence is shared by many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Width of a bucket, in tolerances.
BUCKET = 4096


def asof_nearest(left: DataFrame, right: DataFrame, keys: list[str], *, tolerance: float, time: str = "time_sec", right_time: str | None = None, how: str = "inner", bucket: int = BUCKET) -> DataFrame:
    """Left rows with the nearest right row of the same key at most ``tolerance`` away (inclusive).

    Of equally near rows the earlier one is taken; of rows at one time, the last by their columns before the left row,
    the first after it. ``how="left"`` keeps rows without a match, with nulls.
    """
    right_time = right_time or time
    values = [c for c in right.columns if c not in keys and c != right_time]
    width = F.lit(float(tolerance) * bucket if tolerance else 1.0)
    lo, hi = (F.floor((F.col(right_time) + s * F.lit(float(tolerance))) / width) for s in (-1, 1))
    r = right.where(F.col(right_time).isNotNull()).select(
        *keys, F.explode(F.sequence(lo, hi)).alias("__bucket"), F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.struct(F.col(right_time).alias("__rt"), *values).alias("__r"), F.lit(None).cast(left.schema).alias("__l")
    )
    l = left.select(  # noqa: E741
        *keys, F.floor(F.col(time) / width).alias("__bucket"), F.col(time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(r.schema["__r"].dataType).alias("__r"), F.struct(*left.columns).alias("__l")
    )
    both = r.unionByName(l)
    part = Window.partitionBy(*keys, "__bucket")
    # Right rows come first at one time going forward; going backward a left row must see those strictly later only.
    ahead = part.orderBy("__t", "__side", "__r").rowsBetween(Window.unboundedPreceding, 0)
    behind = part.orderBy(F.desc("__t"), F.desc("__side"), F.desc("__r")).rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumns({"__b": F.last("__r", ignorenulls=True).over(ahead), "__f": F.last("__r", ignorenulls=True).over(behind)}).where("__side = 1")
    back, fore = F.col("__t") - F.col("__b.__rt"), F.col("__f.__rt") - F.col("__t")
    pick = F.when(back.isNotNull() & (fore.isNull() | (back <= fore)), F.col("__b")).otherwise(F.col("__f"))
    found = near.withColumn("__m", pick)
    fits = F.abs(F.col("__m.__rt") - F.col("__t")) <= F.lit(float(tolerance))
    if how == "inner":
        found = found.where(fits)
    names = [c if c not in left.columns else f"{c}_right" for c in values]
    return found.select("__l.*", *(F.when(fits, F.col(f"__m.{c}")).alias(n) for c, n in zip(values, names, strict=True)))


def interval_join(points: DataFrame, intervals: DataFrame, keys: list[str], *, width: float, time: str = "time_sec", start: str = "start_sec", end: str = "end_sec") -> DataFrame:
    """Points with the intervals [start, end) of the same key that hold them.

    Intervals are listed in the time buckets of ``width`` they meet (about the length of a usual interval), points in
    theirs, and both are joined by bucket.
    """
    w = F.lit(float(width))
    placed = points.withColumn("__bucket", F.floor(F.col(time) / w))
    spread = intervals.where(F.col(start) < F.col(end)).withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(start) / w), F.floor(F.col(end) / w))))
    return placed.join(spread, [*keys, "__bucket"]).where((F.col(time) >= F.col(start)) & (F.col(time) < F.col(end))).drop("__bucket")


def next_event_within(events: DataFrame, responses: DataFrame, keys: list[str], *, window: float, time: str = "event_sec", name: str = "responded") -> DataFrame:
    """Events with whether a response of the same key happens in [time, time + window): the next response decides."""
    # Buckets of time share a long sequence among tasks; a response is also listed in those that hold events it can answer.
    width = F.lit(float(window) * BUCKET if window else 1.0)
    held = F.explode(F.sequence(F.floor((F.col(time) - F.lit(float(window))) / width), F.floor(F.col(time) / width))).alias("__bucket")
    r = responses.where(F.col(time).isNotNull()).select(*keys, held, F.col(time).alias("__t"), F.lit(0).alias("__side"), F.col(time).alias("__next"), F.lit(None).cast(events.schema).alias("__e"))
    e = events.select(*keys, F.floor(F.col(time) / width).alias("__bucket"), F.col(time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast("double").alias("__next"), F.struct(*events.columns).alias("__e"))
    order = Window.partitionBy(*keys, "__bucket").orderBy(F.desc("__t"), "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = r.unionByName(e).withColumn("__soon", F.last("__next", ignorenulls=True).over(order)).where("__side = 1")
    return found.select("__e.*", F.coalesce(F.col("__soon") < F.col("__t") + F.lit(float(window)), F.lit(False)).alias(name))
