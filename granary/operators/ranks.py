"""Places in a total order over a whole table, without a window over one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.sources.scratch import written

_LOW = (1 << 33) - 1  # monotonically_increasing_id() is the partition above this many bits and the place within it


def numbered(df: DataFrame, *order: Column, place: str = "place", total: str = "total") -> DataFrame:
    """``df`` with ``place`` (from 1, in this order) and ``total`` (all rows).

    Rows are dealt by ranges of the order and sorted where they lie; each then knows its place within its range, and the places of the
    ranges before it come from one count a range. So the only rows that meet in one task are those counts, of which there
    are as many as shuffle partitions. The sorted rows are a written table: counts and places are of the same dealing,
    and survive lost executors. Rows alike in the whole order lie in one range.
    """
    at, part, before, here = "_at", "_part", "_before", "_here"
    rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()))
    counts = rows.groupBy(F.shiftright(at, 33).alias(part)).agg(F.count(F.lit(1)).alias(here))
    all_before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = counts.select(part, F.coalesce(F.sum(here).over(all_before), F.lit(0)).alias(before), F.sum(here).over(whole).alias(total))
    joined = rows.join(F.broadcast(starts), F.shiftright(at, 33) == F.col(part))  # a row for each shuffle partition
    return joined.select(*df.columns, (F.col(before) + F.col(at).bitwiseAND(F.lit(_LOW)) + 1).alias(place), total)
