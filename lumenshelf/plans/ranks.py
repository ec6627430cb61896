"""Ranks in a global order, or in the order of each group, without one task for all rows or for one group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import settled

_ROW_BITS = 33  # monotonically_increasing_id() has the partition above them, the row below
#: First ranks of parts are broadcast up to this many, a few dozen bytes each, and joined by shuffle beyond.
BROADCAST_PARTS = 200_000


def ranked(rows: DataFrame, order: list[Column], keys: list[str], within: Sequence[str] = (), total: str | None = None) -> DataFrame:
    """Adds rank (from 0), in all rows or in those that agree in ``within``; ``total`` names a column for their number.

    Rows are dealt to ranges of (within, order, keys) and sorted there, so a group of
    any size spreads over as many ranges as it needs. A row's number in its range needs
    no further exchange; the sizes of the ranges, or of a group's parts in them, give
    each part its first rank. ``keys`` (unique columns) end the order.
    """
    full = [*[F.col(c) for c in within], *order, *[F.col(k) for k in keys]]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *full).sortWithinPartitions(*full).withColumn("_id", F.monotonically_increasing_id())
    inside = settled(dealt, "ranges")  # the ranges come from a sample: computed once
    inside = inside.withColumn("_part", F.shiftright("_id", _ROW_BITS)).withColumn("_at", F.col("_id").bitwiseAND((1 << _ROW_BITS) - 1)).drop("_id")
    parts = inside.groupBy(*within, "_part").agg(F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*within)
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    more = [F.sum("_n").over(group).alias(total)] if total else []
    first = parts.select(*within, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_low")).alias("_first"), *more)
    first = settled(first, "range-starts")
    few = not within or first.count() <= BROADCAST_PARTS  # without groups there is one row for each range
    out = inside.join(F.broadcast(first) if few else first, [*within, "_part"])
    return out.withColumn("rank", (F.col("_first") + F.col("_at")).cast("long")).select(*rows.columns, "rank", *([total] if total else []))
