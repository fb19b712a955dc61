"""Running aggregates over an order, split into even slices whatever the key distribution.

A window partitioned by a hot key runs in one task. Here the rows are range-partitioned by
(keys, order) instead, so a hot key spans many slices; each slice is scanned on its own and the
totals of the earlier slices, one small row per (slice, key), are carried in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procspark.session import cut, shuffle_width

SLICE = "slice_no"


def slices(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int | None = None) -> DataFrame:
    """Range-partition by (keys, order) and number the partitions. ``order`` must be unique per key.

    The rows are written to the shared folder first: a recomputed range partition could fall on other
    bounds, and the slice numbers must never change under a reader.
    """
    n = n or shuffle_width(df.sparkSession)
    ranged = df.repartitionByRange(n, *keys, *order).withColumn(SLICE, F.spark_partition_id())
    return cut(ranged)


def in_slice(keys: Sequence[str], order: Sequence[str], first: int = Window.unboundedPreceding,
             last: int = -1):
    return Window.partitionBy(SLICE, *keys).orderBy(*order).rowsBetween(first, last)


def carried(sliced: DataFrame, keys: Sequence[str], partials: dict[str, tuple[Column, object]]) -> DataFrame:
    """Per (slice, keys): every partial combined over the earlier slices of the same keys.

    ``partials[name] = (aggregate within a slice, combiner of such aggregates)``. A key has at most one
    row per slice here, so the window below holds at most as many rows as there are slices.
    """
    per_slice = sliced.groupBy(SLICE, *keys).agg(*[agg.alias(name) for name, (agg, _) in partials.items()])
    by_key = [F.col(k) for k in keys] or [F.lit(0)]
    earlier = Window.partitionBy(*by_key).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    return per_slice.select(
        SLICE, *keys, *[combine(F.col(name)).over(earlier).alias(f"{name}_carry")
                        for name, (_, combine) in partials.items()])


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str],
                 n: int | None = None) -> DataFrame:
    """Add ``<col>_before``: the sum of ``col`` over the strictly earlier rows of the same keys."""
    sliced = slices(df, keys, order, n)
    carry = carried(sliced, keys, {c: (F.sum(c), F.sum) for c in cols})
    w = in_slice(keys, order)
    joined = sliced.join(carry, [SLICE, *keys])
    zero = F.lit(0)
    return joined.select(
        *df.columns,
        *[(F.coalesce(F.sum(c).over(w), zero) + F.coalesce(F.col(f"{c}_carry"), zero)).alias(f"{c}_before")
          for c in cols])
