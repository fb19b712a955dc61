"""Synthetic history and labelled fraud patterns, as table jobs seeded by hashes.

All noise comes from hashes of (vendor, number, purpose), so a rerun on any cluster gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procspark.operators.scan import running_sums
from procspark.session import cut


# Patterns and their counts per set, and the synthetic-row ceiling.
SMALL_LIMIT = 10_000.0
ROUND_AMOUNTS = [50_000.0, 100_000.0, 250_000.0, 500_000.0, 1_000_000.0]
LIMITS = [10_000.0, 25_000.0, 100_000.0, 250_000.0]
LARGE_MEDIAN = 50_000.0
LOG_SPREAD, FLOOR, MIN_STD = 0.25, 100.0, 100.0
CAP_SHARE, CAP_MIN, DENSE = 0.05, 100, 15
CELLS = 1000


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the digest of its parts, the same in any engine."""
    text = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 10), 16, 10).cast("bigint") / F.lit(float(1 << 40))


def _between(low: float, high: float, u: Column) -> Column:
    return F.lit(low) + u * F.lit(high - low)


def _normal(*parts: Column | str) -> Column:
    """Box-Muller from two hashes."""
    u = F.greatest(uniform(*parts, "a"), F.lit(1e-12))
    return F.sqrt(-2.0 * F.log(u)) * F.cos(2.0 * F.pi() * uniform(*parts, "b"))


def _off_weekend(ts: Column, u: Column) -> Column:
    """Nineteen of twenty times Saturday moves to Friday and Sunday to Monday."""
    day = F.weekday(ts)
    shift = F.when(day == 5, -1).when(day == 6, 1).otherwise(0)
    return F.timestamp_add("DAY", F.when(u < 0.95, shift).otherwise(0), ts)


def vendor_medians(df: DataFrame) -> DataFrame:
    """``vendor_id, median`` of the amounts, exact: equal amounts are counted first, then ranked in slices, so a hot vendor is no task."""
    counts = df.groupBy("vendor_id", "cents").agg(F.count("*").alias("n"))
    ranked = running_sums(counts, ["vendor_id"], ["cents"], ["n"])
    total = counts.groupBy("vendor_id").agg(F.sum("n").alias("total"))
    low, high = F.floor((F.col("total") - 1) / 2), F.ceil((F.col("total") - 1) / 2)
    inside = lambda k: (k >= F.col("n_before")) & (k < F.col("n_before") + F.col("n"))
    both = ranked.join(total, "vendor_id").groupBy("vendor_id").agg(
        F.max(F.when(inside(low), F.col("cents"))).alias("a"), F.max(F.when(inside(high), F.col("cents"))).alias("b"))
    return both.select("vendor_id", ((F.col("a") / F.lit(100.0) + F.col("b") / F.lit(100.0)) / 2.0).alias("median"))


def vendor_stats(df: DataFrame) -> DataFrame:
    """Median, spread and first date per vendor, the same on any cluster."""
    money = F.col("cents") / F.lit(100.0)
    stats = df.groupBy("vendor_id").agg(F.stddev_samp(money).alias("std"), F.min("ts").alias("first_ts"))
    stats = cut(vendor_medians(df).join(stats, "vendor_id"))
    return stats.withColumn("std", F.greatest(F.coalesce("std", F.col("median") * 0.3), F.lit(MIN_STD)))


def expand_vendor_history(df: DataFrame, per_vendor: int = 15, seed: int = 42) -> DataFrame:
    """``per_vendor`` normal invoices per vendor before its first one, 14 to 90 days apart."""
    s = F.lit(seed)
    rows = vendor_stats(df).select("vendor_id", "median", "first_ts", F.explode(F.sequence(F.lit(1), F.lit(per_vendor))).alias("k"))
    gap = F.floor(_between(14, 91, uniform(F.col("vendor_id"), F.col("k"), s, "gap")))
    back = F.sum(gap).over(Window.partitionBy("vendor_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("back", back)
    ts = _off_weekend(F.timestamp_add("DAY", -F.col("back").cast("int"), F.col("first_ts")), uniform(F.col("vendor_id"), F.col("k"), s, "day"))
    amount = F.greatest(F.exp(F.log(F.greatest("median", F.lit(1.0))) + _normal(F.col("vendor_id"), F.col("k"), s, "amount") * LOG_SPREAD), F.lit(FLOOR))
    return rows.select("vendor_id", F.concat_ws("-", F.lit("syn"), "vendor_id", "k").alias("tx_id"),
                       F.round(amount * 100).cast("bigint").alias("cents"), ts.alias("ts"), F.lit(True).alias("is_synthetic"),
                       F.lit("NORMAL").alias("anomaly_type"))


def inject_labeled_anomalies(df: DataFrame, n_normal: int = 300, n_per_type: int = 50, seed: int = 777) -> DataFrame:
    """Labelled rows after the data: normals and seven fraud patterns on vendors drawn by hash.

    The number of rows is set by the arguments; each set picks its vendor as the one whose hash is next to the
    set's own, by a join on hash-ordered vendor numbers, so no vendor list reaches the driver.
    """
    spark = df.sparkSession
    sets = [("NORMAL", n_normal, 1), ("WEEKEND_SPIKE", n_per_type, 1), ("SPLIT_BILLING", max(1, n_per_type // 3), 3),
            ("VELOCITY_SPIKE", max(1, n_per_type // 5), 5), ("RATIO_OUTLIER", n_per_type, 1), ("ROUND_NUMBER", n_per_type, 1),
            ("BURST_24H", max(1, n_per_type // 4), 5), ("APPROVAL_LIMIT", n_per_type, 1)]
    plan = spark.createDataFrame([(t, n, k) for t, n, k in sets], "anomaly_type string, sets int, rows int")
    s = F.lit(seed)
    drawn = plan.select("anomaly_type", "rows", F.explode(F.sequence(F.lit(1), F.col("sets"))).alias("set_no")).withColumn(
        "ticket", uniform(F.col("anomaly_type"), F.col("set_no"), s, "vendor"))
    stats = vendor_stats(df)
    drawn = _draw_vendor(drawn, stats)
    base = df.agg(F.max("ts")).first()[0]
    rows = drawn.select("*", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"))
    one = lambda purpose: uniform(F.col("anomaly_type"), F.col("set_no"), s, purpose)
    each = lambda purpose: uniform(F.col("anomaly_type"), F.col("set_no"), F.col("i"), s, purpose)
    kind = F.col("anomaly_type")
    horizon = F.when(kind == "NORMAL", 180).when(kind.isin("SPLIT_BILLING", "VELOCITY_SPIKE", "BURST_24H"), 80).otherwise(90)
    day0 = F.timestamp_add("DAY", (1 + 1 + F.floor(one("offset") * (horizon - 1))).cast("int"), F.lit(base))
    to_saturday = F.pmod(F.lit(5) - F.weekday(day0), F.lit(7))
    ts = (
        F.when(kind == "WEEKEND_SPIKE", F.timestamp_add("DAY", F.when(to_saturday == 0, 6).otherwise(to_saturday), day0))
        .when(kind.isin("SPLIT_BILLING", "VELOCITY_SPIKE"), F.timestamp_add("DAY", F.col("i"), day0))
        .when(kind == "BURST_24H", F.timestamp_add("HOUR", F.col("i") * 3, day0))
        .otherwise(_off_weekend(day0, one("weekday"))))
    median = F.col("median")
    pick = lambda values, u: F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(u * len(values)) + 1).cast("int"))
    amount = (
        F.when(kind == "NORMAL", F.greatest(F.exp(F.log(F.greatest(median, F.lit(1.0))) + _normal(kind, F.col("set_no"), s, "amount") * LOG_SPREAD), F.lit(FLOOR)))
        .when(kind == "WEEKEND_SPIKE", median * _between(3.0, 8.0, each("amount")))
        .when(kind == "SPLIT_BILLING", _between(SMALL_LIMIT * 0.92, SMALL_LIMIT * 0.998, each("amount")))
        .when(kind == "VELOCITY_SPIKE", median * _between(0.85, 1.15, each("amount")))
        .when(kind == "RATIO_OUTLIER", median * _between(20.0, 50.0, each("amount")))
        .when(kind == "ROUND_NUMBER", pick(ROUND_AMOUNTS, each("amount")))
        .when(kind == "BURST_24H", median * _between(0.80, 1.20, each("amount")))
        .otherwise(pick(LIMITS, each("limit")) * _between(0.950, 0.999, each("amount"))))
    return rows.select(
        "vendor_id", F.concat_ws("-", F.lit("eval"), kind, "set_no", "i").alias("tx_id"), F.round(amount * 100).cast("bigint").alias("cents"),
        ts.alias("ts"), F.lit(True).alias("is_synthetic"), "anomaly_type", (kind != "NORMAL").cast("int").alias("label"))


def _draw_vendor(tickets: DataFrame, stats: DataFrame) -> DataFrame:
    """Give every ticket in [0, 1) a vendor: the one with the smallest hash at or above it, else the smallest.

    Split billing draws among vendors with a large median, if there are any. Vendors meet tickets on equal
    thousandths of the unit interval; a ticket above all vendors of its stretch takes the next stretch's first.
    """
    large = stats.filter(F.col("median") > LARGE_MEDIAN)
    parts = [(tickets.filter(F.col("anomaly_type") != "SPLIT_BILLING"), stats),
             (tickets.filter(F.col("anomaly_type") == "SPLIT_BILLING"), stats if large.isEmpty() else large)]
    out = None
    for ask, vendors in parts:
        v = vendors.withColumn("u", uniform(F.col("vendor_id"), "draw")).withColumn("cell", F.floor(F.col("u") * CELLS).cast("int"))
        first = F.struct("u", "vendor_id", "median")
        # at most 1000 rows, whatever the number of vendors
        heads = v.groupBy("cell").agg(F.min(first).alias("head"))
        ring = tickets.sparkSession.range(CELLS).select(F.col("id").cast("int").alias("cell")).join(heads, "cell", "left")
        later = Window.partitionBy(F.lit(0)).orderBy("cell").rowsBetween(1, Window.unboundedFollowing)
        ring = ring.select("cell", F.coalesce(F.first("head", ignorenulls=True).over(later),
                                              F.min("head").over(Window.partitionBy(F.lit(0)))).alias("after"))
        a = ask.withColumn("cell", F.floor(F.col("ticket") * CELLS).cast("int"))
        near = a.join(v.select("cell", first.alias("c")), "cell").filter(F.col("c.u") >= F.col("ticket")).groupBy(
            "anomaly_type", "set_no").agg(F.min("c").alias("near"))
        got = a.join(near, ["anomaly_type", "set_no"], "left").join(ring, "cell").withColumn("got", F.coalesce("near", "after"))
        part = got.select(*ask.columns, "got.vendor_id", "got.median")
        out = part if out is None else out.unionByName(part)
    return out


def augment_cap(real: DataFrame, seed: int = 42) -> DataFrame:
    """Synthetic history within its ceiling: none for dense data, else at most five percent (or 100 rows)."""
    row = real.agg(F.count("*").alias("n"), F.count_distinct("vendor_id").alias("v")).first()
    n, vendors = row["n"], max(row["v"], 1)
    ceiling = max(int(n * CAP_SHARE), CAP_MIN)
    if n / vendors >= DENSE:
        return expand_vendor_history(real.filter(F.lit(False)), 1, seed)
    rows = expand_vendor_history(real, max(1, ceiling // vendors), seed)
    # an exact cut of the digest order, ranked in slices: no task holds more than its share
    ranked = running_sums(rows.withColumns({"draw": uniform(F.col("tx_id"), F.lit(seed)), "one": F.lit(1)}), [], ["draw", "tx_id"], ["one"])
    return ranked.filter(F.col("one_before") < ceiling).drop("draw", "one", "one_before")


