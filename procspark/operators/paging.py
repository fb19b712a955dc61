"""Listings that are paged by cursor: a range-sorted layout with one zone per slice.

``offset`` sorts everything and skips all earlier pages. A listing is written once in its order, as slices, with a zone row for each: how many
rows it has and its first and last. A page is then read from the slices that can hold it, wherever it lies: by cursor (the sort keys
of the last row seen, so inserts elsewhere never shift it) or by number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procspark.session import shuffle_width

SLICE = "slice_no"


@dataclass(frozen=True)
class Zone:
    slice_no: int
    rows: int
    first: tuple
    last: tuple


@dataclass
class Listing:
    """Rows in the order newest first, then by key; rows without a time come last."""

    spark: SparkSession
    path: str
    schema: T.StructType
    newest: str
    key: str
    zones: list[Zone]  # one for each slice, in order

    @property
    def total(self) -> int:
        return sum(z.rows for z in self.zones)

    def _order(self) -> list[Column]:
        return [F.desc_nulls_last(self.newest), F.asc(self.key)]

    def _rows(self, zones: list[Zone]) -> DataFrame:
        if not zones:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{SLICE}={z.slice_no}" for z in zones])

    @staticmethod
    def _place(at: tuple) -> tuple:
        """For comparison on the driver: a later place is greater."""
        time, key = at
        return (time is None, 0 if time is None else -time.timestamp() if hasattr(time, "timestamp") else -time, key)

    def _beyond(self, cursor: tuple) -> Column:
        time, key = cursor
        t, k = F.col(self.newest), F.col(self.key)
        if time is None:
            return t.isNull() & (k > F.lit(key))
        at = F.lit(str(time)).cast(self.schema[self.newest].dataType)  # as text: a literal of Python's would pass through the driver's time zone
        return t.isNull() | (t < at) | ((t == at) & (k > F.lit(key)))

    def after(self, cursor: tuple | None, size: int, where: Column | None = None) -> DataFrame:
        """The ``size`` rows that follow the row with the sort keys ``cursor`` (from the start with None), of those that ``where`` lets pass.

        Slices are taken in order, from the one the cursor falls into; with ``where`` twice as many each time until the page is full.
        """
        rest = [z for z in self.zones if cursor is None or self._place(z.last) > self._place(cursor)]
        n = 1
        while True:
            take = rest[:n]
            if where is None:  # rows of the first slice may lie before the cursor, those of the others do not
                while n < len(rest) and sum(z.rows for z in rest[1 if cursor else 0:n]) < size:
                    n += 1
                take = rest[:n]
            rows = self._rows(take)
            if cursor is not None:
                rows = rows.filter(self._beyond(cursor))
            if where is not None:
                rows = rows.filter(where)
            page = rows.orderBy(*self._order()).limit(size)
            if where is None or len(take) == len(rest) or page.count() == size:
                return page
            n *= 2

    def page(self, number: int, size: int) -> DataFrame:
        """Page ``number`` from 1: the zones' counts tell which slices it lies in; only these are read."""
        start, before, take = (number - 1) * size, 0, []
        skip = None
        for z in self.zones:
            if before + z.rows > start and before < start + size:
                skip = start - before if skip is None else skip
                take.append(z)
            before += z.rows
        return self._rows(take).orderBy(*self._order()).offset(max(skip or 0, 0)).limit(size)


def write_listing(df: DataFrame, path: str, newest: str, key: str, slices: int | None = None) -> Listing:
    """Write ``df`` as a listing under ``path``, in one pass and one sort; ``key`` is unique. The zones are one row per slice."""
    spark = df.sparkSession
    order = [F.desc_nulls_last(newest), F.asc(key)]
    ranged = df.repartitionByRange(slices or shuffle_width(spark), *order).sortWithinPartitions(*order)
    ranged.withColumn(SLICE, F.spark_partition_id()).write.mode("overwrite").partitionBy(SLICE).parquet(path)
    kept = spark.read.schema(T.StructType([*df.schema.fields, T.StructField(SLICE, T.IntegerType())])).parquet(path)
    at = F.struct(F.col(newest).alias("t"), F.col(key).alias("k"))
    # rows without a time are the last of the order: the smallest time first puts null first, so the key decides among them
    place = F.struct(F.col(newest).isNull(), F.negative(F.unix_micros(F.col(newest).cast("timestamp"))) if isinstance(df.schema[newest].dataType, (T.TimestampType, T.TimestampNTZType))
                     else F.negative(F.col(newest)), F.col(key))
    rows = kept.groupBy(SLICE).agg(F.count("*").alias("n"), F.min_by(at, place).alias("first"), F.max_by(at, place).alias("last")).collect()
    zones = [Zone(r[SLICE], r.n, (r["first"].t, r["first"].k), (r["last"].t, r["last"].k)) for r in sorted(rows, key=lambda r: r[SLICE])]
    return Listing(spark, path, df.schema, newest, key, zones)
