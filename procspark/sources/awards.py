"""Award records: parsing, source-side filters and the sector by year selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procspark.functions.values import first_of, json_amount, safe_timestamp
from procspark.sources.payloads import once

# Contract award types and the smallest amount of interest.
CONTRACT_TYPES = ["A", "B", "C", "D"]
MIN_AMOUNT = 1_000

# Industry codes per sector, and the year windows (the last one is a part year).
SECTORS = {
    "information_technology": ["541511", "541512", "541513", "541519", "518210"],
    "construction": ["236220", "237110", "237310", "238210", "238990"],
    "professional_consulting": ["541611", "541613", "541620", "541690", "541990"],
    "manufacturing_equipment": ["332710", "332999", "334111", "334511", "336413"],
    "healthcare_medical": ["325412", "339112", "541714", "621498", "334510"],
    "logistics_transport": ["484110", "484121", "488510", "492110", "541614"],
    "engineering_scientific": ["541310", "541330", "541360", "541380", "541712"],
    "facilities_maintenance": ["561210", "561720", "561730", "238220", "238350"],
}
YEAR_WINDOWS = [(f"{y}-01-01", f"{y}-12-31") for y in range(2019, 2025)] + [("2025-01-01", "2025-03-31")]


AMOUNTS = ("Award Amount", "Total Outlays")


def parse_award_record(df: DataFrame, ingest_ts: Column) -> DataFrame:
    """Twelve typed fields from a raw award in column ``raw``; a bad amount is 0."""
    names = ["Award ID", "Recipient Name", "Recipient DUNS Number", "Place of Performance Country Code",
             "Award Amount", "Total Outlays", "Last Modified Date", "Fiscal Year", "Award Type",
             "NAICS Description", "Description", "Awarding Agency"]
    df = once(df, "p", F.from_json("raw", "struct<" + ",".join(f"`{n}`: {'variant' if n in AMOUNTS else 'string'}" for n in names) + ">"))
    f = lambda n: F.col("p")[n]
    return df.select(
        *[c for c in df.columns if c not in ("raw", "p")],
        F.coalesce(f("Award ID"), F.lit("")).alias("external_id"),
        first_of(f("Recipient Name"), default="UNKNOWN VENDOR").alias("vendor_name"),
        f("Recipient DUNS Number").alias("vendor_uei"),
        f("Place of Performance Country Code").alias("vendor_country"),
        json_amount(*[f(n) for n in AMOUNTS]).cast("double").alias("amount"),
        safe_timestamp(f("Last Modified Date"), ingest_ts).alias("action_date"),
        f("Fiscal Year").cast("int").alias("fiscal_year"),
        f("Award Type").alias("award_type"),
        f("NAICS Description").alias("category"),
        f("Description").alias("description"),
        f("Awarding Agency").alias("awarding_agency"),
        F.col("raw").alias("raw_data"),
    )


def award_filter(df: DataFrame, start: str, end: str, codes: list[str] | None = None,
                 page: int | None = None, limit: int = 100) -> DataFrame:
    """Contracts of a date range above the minimum amount, newest first, optionally one page of them."""
    day = F.to_date("action_date")
    out = df.filter(
        day.between(F.lit(start).cast("date"), F.lit(end).cast("date"))
        & F.col("award_type").isin(*CONTRACT_TYPES) & (F.col("amount") >= MIN_AMOUNT))
    if codes:
        out = out.filter(F.col("naics").isin(*codes))
    if page is not None:
        out = out.orderBy(F.desc("action_date"), "external_id").offset((page - 1) * limit).limit(limit)
    return out


def sector_year_grid(df: DataFrame, completed: DataFrame | None = None,
                     windows: list[tuple[str, str]] = YEAR_WINDOWS) -> DataFrame:
    """Awards by sector and year window; an award is kept once, in its first cell of the grid.

    The grid is a fixed list of sectors x codes x windows, so its broadcast never grows; finished cells
    are taken out of it before any award is read.
    """
    spark = df.sparkSession
    cells = [(i * len(windows) + j, sector, code, start, end, f"{sector}|{start[:4]}")
             for i, (sector, codes) in enumerate(SECTORS.items())
             for j, (start, end) in enumerate(windows) for code in codes]
    grid = spark.createDataFrame(cells, "cell int, sector string, code string, start string, stop string, combo string")
    if completed is not None:
        grid = grid.join(completed.select("combo"), "combo", "left_anti")
    day = F.to_date("action_date")
    hit = df.join(F.broadcast(grid), (F.col("naics") == F.col("code"))
                  & day.between(F.col("start").cast("date"), F.col("stop").cast("date")))
    rest = [c for c in df.columns if c != "external_id"]
    return hit.filter(F.coalesce(F.col("external_id") != "", F.lit(False))).groupBy("external_id").agg(
        F.min_by(F.struct(*rest, "sector", "combo"), F.struct("cell", *[c for c in ("action_date", "amount") if c in rest]))
        .alias("r")).select("external_id", "r.*")
