"""Table layout on plain Parquet: what an index does elsewhere is done by folders and sort order here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONTH = "tx_month"


def write_by_month(df: DataFrame, path: str, files_per_month: int = 8) -> None:
    """Partition by month for pruning, and sort by vendor within files so that min/max statistics skip row groups.

    Vendors are dealt to a month's files by hash of vendor and day, which also splits a vendor that fills a month.
    """
    month = F.date_format("ts", "yyyy-MM")
    part = F.pmod(F.xxhash64("vendor_id", F.to_date("ts")), F.lit(files_per_month))
    rows = df.withColumns({MONTH: month, "file_no": part})
    rows.repartition(MONTH, "file_no").drop("file_no").sortWithinPartitions(MONTH, "vendor_id", "ts").write.mode(
        "overwrite").partitionBy(MONTH).parquet(path)


def read_months(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """Months from ``first`` to ``last`` (yyyy-MM); other folders are never listed into a task."""
    return spark.read.parquet(path).filter(F.date_format(F.to_date(F.col(MONTH).cast("string"), "yyyy-MM"), "yyyy-MM").between(first, last))
