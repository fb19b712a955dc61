"""Per-vendor temporal, behavioural and peer features (22 columns).

Input: ``vendor_id, tx_id (unique), ts, cents`` and optionally ``agency``. "Prior" means earlier by
position in the vendor's series ordered by (ts, tx_id), so of several invoices with one timestamp each
sees those sorted before it; every look-back includes its lower bound.

Two physical forms give the same result:

* ordinary vendors: one hash exchange by vendor and one sort; all frames read that order;
* vendors with more rows than ``hot_rows``: their rows are spread over even slices and every window
  becomes a difference of two running totals (see ``_sweep``), so no task holds a whole vendor and
  long windows are never re-summed per row.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procspark.functions.money import is_round, near_limit
from procspark.operators.scan import carried, in_slice, running_sums, slices
from procspark.session import Hold, cut, lookup

# The feature names and their order, the small-invoice limit and the look-backs.
FEATURES = [
    "amount_log",
    "vendor_30d_velocity",
    "days_since_last_invoice",
    "is_weekend_payment",
    "amount_vs_vendor_avg",
    "invoice_count_7d",
    "invoice_count_30d",
    "rolling_7d_sum",
    "max_invoices_7d_window",
    "consecutive_small_invoices",
    "amount_std_30d",
    "is_round_amount",
    "invoice_count_24h",
    "invoice_count_48h",
    "invoice_sum_48h",
    "approval_limit_proximity",
    "freq_change_rate",
    "amount_zscore_30d",
    "invoice_spacing_cv",
    "small_invoice_cluster_14d",
    "amount_vs_category_avg",
    "invoice_freq_vs_category",
]
SMALL_CENTS = 1_000_000
HOUR = 3_600_000_000
DAY = 24 * HOUR

# A sliding frame is re-summed for every row, so its cost grows with the square of a dense vendor; beyond this
# many rows the sweep is used, whose cost is linear.
HOT_ROWS = 20_000


def micros(ts: str | Column) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def is_weekend(ts: str) -> Column:
    return F.weekday(ts) >= 5


def _money(c: Column) -> Column:
    return c / F.lit(100.0)


def _ratio(top: Column, bottom: Column) -> Column:
    return top.cast("double") / bottom


def _with_clock(df: DataFrame) -> DataFrame:
    """Time and size marks. A row without vendor or time stands alone (``solo``): it has no history and is in nobody's, and such
    rows are as many keys as rows, whatever their number."""
    alone = F.when(F.col("vendor_id").isNull() | F.col("ts").isNull(), F.col("tx_id").cast("string"))
    return df.withColumns({"us": micros("ts"), "small": (F.col("cents") < SMALL_CENTS).cast("long"), "solo": alone})


# ---------------------------------------------------------------------------------------------
# ordinary vendors


def _window_counts(df: DataFrame) -> DataFrame:
    """The raw window measures with built-in frames.

    A RANGE frame ends one microsecond before the row, which leaves out all rows of the same timestamp;
    those sorted earlier are added from a running frame inside (vendor, us). All three window
    specifications are served by one sort on (vendor, us, tx_id).
    """
    rows = df.repartition("vendor_id", "solo")
    peers = Window.partitionBy("vendor_id", "solo", "us").orderBy("tx_id").rowsBetween(Window.unboundedPreceding, -1)
    by_time = Window.partitionBy("vendor_id", "solo").orderBy("us")
    line = Window.partitionBy("vendor_id", "solo").orderBy("us", "tx_id")
    prior = line.rowsBetween(Window.unboundedPreceding, -1)

    def back(width: int):
        return by_time.rangeBetween(-width, -1)

    money = F.col("cents") / F.lit(100.0)
    zero = F.lit(0)
    total = lambda col, w: F.coalesce(F.sum(col).over(w), zero)
    rows = rows.select(
        *df.columns,
        F.row_number().over(line).alias("pos"),
        F.count("*").over(peers).alias("p_n"),
        total("cents", peers).alias("p_sum"),
        total("small", peers).alias("p_small"),
        F.avg(money).over(peers).alias("p_avg"),
        F.var_pop(money).over(peers).alias("p_var"),
        F.count("*").over(back(DAY)).alias("r_n24"),
        F.count("*").over(back(2 * DAY)).alias("r_n48"),
        total("cents", back(2 * DAY)).alias("r_sum48"),
        F.count("*").over(back(7 * DAY)).alias("r_n7"),
        F.count("*").over(back(7 * DAY - 1)).alias("r_n7x"),
        total("cents", back(7 * DAY)).alias("r_sum7"),
        total("small", back(14 * DAY)).alias("r_small14"),
        F.count("*").over(back(30 * DAY)).alias("r_n30"),
        total("cents", back(30 * DAY)).alias("r_sum30"),
        F.avg(money).over(back(30 * DAY)).alias("r_avg30"),
        F.var_pop(money).over(back(30 * DAY)).alias("r_var30"),
        F.count("*").over(prior).alias("n_prior"),
        F.sum("cents").over(prior).alias("sum_prior"),
        F.lag("us").over(line).alias("prev_us"),
    )
    hours = lambda c: F.floor(c / F.lit(HOUR))
    last9 = line.rowsBetween(-9, -1)
    span = F.col("r_n7x") + F.col("p_n") + 1
    rows = (
        rows.withColumn("gap", hours(F.col("us")) - hours(F.col("prev_us")))
        .withColumn("span7", span)
        .withColumn("big_pos", F.when(F.col("small") == 0, F.col("pos")))
        .select(
            "*",
            F.max("span7").over(prior).alias("max7"),
            F.max("big_pos").over(prior).alias("last_big"),
            F.count("gap").over(last9).alias("gap_n"),
            F.avg("gap").over(last9).alias("gap_avg"),
            F.stddev_pop("gap").over(last9).alias("gap_std"),
        )
    )
    # variance of the union of the two disjoint row sets (RANGE part and peers)
    na, nb = F.col("r_n30"), F.col("p_n")
    shift = F.coalesce(F.col("r_avg30"), F.lit(0.0)) - F.coalesce(F.col("p_avg"), F.lit(0.0))
    spread = (
        F.coalesce(na * F.col("r_var30"), F.lit(0.0)) + F.coalesce(nb * F.col("p_var"), F.lit(0.0))
        + F.when((na > 0) & (nb > 0), shift * shift * na * nb / (na + nb)).otherwise(0.0)
    )
    n30 = na + nb
    return rows.select(
        *df.columns, "n_prior", "sum_prior", "prev_us",
        (F.col("r_n24") + nb).alias("n24"),
        (F.col("r_n48") + nb).alias("n48"),
        (F.col("r_sum48") + F.col("p_sum")).alias("sum48"),
        (F.col("r_n7") + nb).alias("n7"),
        (F.col("r_sum7") + F.col("p_sum")).alias("sum7"),
        (F.col("r_small14") + F.col("p_small")).alias("small14"),
        n30.alias("n30"),
        (F.col("r_sum30") + F.col("p_sum")).alias("sum30"),
        F.when(n30 > 0, F.sqrt(spread / n30)).alias("std30"),
        F.when(F.col("n_prior") >= 2, F.col("max7")).alias("max7"), "span7",
        (F.col("n_prior") - F.coalesce(F.col("last_big"), F.lit(0))).alias("small_run"),
        "gap_n", "gap_avg", "gap_std",
    )


# ---------------------------------------------------------------------------------------------
# hot vendors

# Look-backs as (name, width in microseconds, lower bound included).
LOOK_BACKS = [
    ("24", DAY, True),
    ("48", 2 * DAY, True),
    ("7", 7 * DAY, True),
    ("7x", 7 * DAY, False),
    ("14", 14 * DAY, True),
    ("30", 30 * DAY, True),
]


def _sweep(df: DataFrame, n_slices: int | None = None) -> DataFrame:
    """The measures of ``_window_counts`` by running totals over an event line.

    Every row also puts one probe on the line per look-back, at ``us - width``: before the rows of that
    time if the bound is included, after them if not. A window is the running total at the row minus
    the running total at its probe. All totals are exact (whole cents, decimal squares).
    """
    row_mark, row_kind = "row", 1
    marks = [F.struct(F.col("us").alias("at"), F.lit(row_kind).alias("kind"), F.lit(row_mark).alias("mark"))]
    for name, width, closed in LOOK_BACKS:
        marks.append(F.struct((F.col("us") - width).alias("at"), F.lit(0 if closed else 2).alias("kind"),
                              F.lit(name).alias("mark")))
    line = df.select("vendor_id", "tx_id", "cents", "small", F.explode(F.array(*marks)).alias("m")).select(
        "vendor_id", "tx_id", "m.*",
        F.when(F.col("m.mark") == row_mark, 1).otherwise(0).cast("long").alias("n"),
        F.when(F.col("m.mark") == row_mark, F.col("cents")).otherwise(0).alias("s"),
        F.when(F.col("m.mark") == row_mark, F.col("small")).otherwise(0).alias("few"),
        F.when(F.col("m.mark") == row_mark, F.col("cents").cast("decimal(19,0)") * F.col("cents").cast("decimal(19,0)"))
        .otherwise(F.lit(0)).cast("decimal(38,0)").alias("q"),
    )
    line = running_sums(line, ["vendor_id"], ["at", "kind", "tx_id", "mark"], ["n", "s", "few", "q"], n_slices)

    def at(mark: str, col: str) -> Column:
        return F.max(F.when(F.col("mark") == mark, F.col(f"{col}_before")))

    def since(mark: str, col: str) -> Column:
        return at(row_mark, col) - at(mark, col)

    measures = line.groupBy("vendor_id", "tx_id").agg(
        at(row_mark, "n").alias("n_prior"), at(row_mark, "s").alias("sum_prior"),
        since("24", "n").alias("n24"), since("48", "n").alias("n48"), since("48", "s").alias("sum48"),
        since("7", "n").alias("n7"), since("7", "s").alias("sum7"),
        (since("7x", "n") + 1).alias("span7"),
        since("14", "few").alias("small14"),
        since("30", "n").alias("n30"), since("30", "s").alias("sum30"), since("30", "q").alias("sq30"),
    )
    rows = df.join(measures, ["vendor_id", "tx_id"])
    # second pass: what depends on the order itself
    rows = rows.withColumn("big_pos", F.when(F.col("small") == 0, F.col("n_prior") + 1))
    keys, order = ["vendor_id"], ["us", "tx_id"]
    sliced = slices(rows, keys, order, n_slices)
    tail = F.sort_array(F.collect_list(F.when(F.col("from_end") <= 10, F.col("us"))))
    ends = Window.partitionBy("slice_no", *keys).orderBy(F.desc("us"), F.desc("tx_id"))
    ranked = sliced.withColumn("from_end", F.row_number().over(ends))
    carry = carried(ranked, keys, {
        "span7": (F.max("span7"), F.max),
        "big_pos": (F.max("big_pos"), F.max),
        "prev_us": (F.max("us"), F.max),
        "tail": (tail, _LastTen),
    })
    w = in_slice(keys, order)
    w10 = in_slice(keys, order, -10, -1)
    out = sliced.join(carry, ["slice_no", *keys])
    recent = F.concat(F.coalesce(F.col("tail_carry"), F.array().cast("array<bigint>")),
                      F.collect_list("us").over(w10))
    out = out.select(
        *df.columns, "n_prior", "sum_prior", "n24", "n48", "sum48", "n7", "sum7", "small14", "n30", "sum30",
        "sq30", "span7",
        F.greatest(F.max("us").over(w), F.col("prev_us_carry")).alias("prev_us"),
        F.greatest(F.max("span7").over(w), F.col("span7_carry")).alias("max7"),
        F.greatest(F.max("big_pos").over(w), F.col("big_pos_carry")).alias("last_big"),
        recent.alias("recent"),
    ).withColumn("recent", _last(F.col("recent")))
    hours = F.transform("recent", lambda x: F.floor(x / F.lit(HOUR)))
    out = out.withColumn("h", hours).withColumn("gaps", F.when(
        F.size("h") >= 2,
        F.transform(F.sequence(F.lit(1), F.size("h") - 1),
                    lambda i: (F.element_at("h", i + 1) - F.element_at("h", i)).cast("double"))
    ).otherwise(F.array().cast("array<double>")))
    gap_n = F.size("gaps")
    gap_avg = F.aggregate("gaps", F.lit(0.0), lambda a, x: a + x) / gap_n
    out = out.withColumn("gap_n", gap_n.cast("long")).withColumn(
        "gap_avg", F.when(F.col("gap_n") > 0, gap_avg))
    gap_var = F.aggregate("gaps", F.lit(0.0),
                          lambda a, x: a + (x - F.col("gap_avg")) * (x - F.col("gap_avg"))) / F.col("gap_n")
    exact = (F.col("n30").cast("decimal(12,0)") * F.col("sq30")
             - F.col("sum30").cast("decimal(19,0)") * F.col("sum30").cast("decimal(19,0)"))
    return out.select(
        *df.columns, "n_prior", F.when(F.col("n_prior") > 0, F.col("sum_prior")).alias("sum_prior"), "prev_us",
        "n24", "n48", "sum48", "n7", "sum7", "small14", "n30", "sum30",
        F.when(F.col("n30") > 0, F.sqrt(exact.cast("double")) / F.col("n30") / 100.0).alias("std30"),
        F.when(F.col("n_prior") >= 2, F.col("max7")).alias("max7"), "span7",
        (F.col("n_prior") - F.coalesce(F.col("last_big"), F.lit(0))).alias("small_run"),
        "gap_n", "gap_avg", F.when(F.col("gap_n") > 0, F.sqrt(gap_var)).alias("gap_std"),
    )


class _LastTen:
    """Combines per-slice arrays of at most ten timestamps into the last ten before a slice."""

    def __init__(self, col: Column):
        self.col = col

    def over(self, window) -> Column:
        return _last(F.flatten(F.collect_list(self.col).over(window)))


def _last(arr: Column, n: int = 10) -> Column:
    """The last ``n`` elements (all of a shorter array)."""
    return F.when(F.size(arr) <= n, arr).otherwise(F.slice(arr, -n, n))


# ---------------------------------------------------------------------------------------------
# features


def hot_vendors(df: DataFrame, hot_rows: int) -> DataFrame:
    """At most rows / hot_rows keys, found by a map-side combined count."""
    return df.groupBy("vendor_id").count().filter(F.col("count") > hot_rows).select("vendor_id")


def measures(df: DataFrame, hot_rows: int = HOT_ROWS, n_slices: int | None = None, count_on: DataFrame | None = None) -> DataFrame:
    """Window measures of every row, by the form that suits its vendor.

    ``count_on``: rows to count the vendors on, where a barer scan with the same vendors is at hand.
    """
    rows = _with_clock(df)
    hot = lookup(hot_vendors(df if count_on is None else count_on, hot_rows))
    if hot.isEmpty():
        return _window_counts(rows)
    timed = F.col("ts").isNotNull()
    parts = [
        _window_counts(rows.filter(timed).join(hot, "vendor_id", "left_anti").unionByName(rows.filter(~timed))),
        _sweep(rows.filter(timed).join(hot, "vendor_id", "left_semi"), n_slices),
    ]
    return reduce(DataFrame.unionByName, parts)


def temporal_features(df: DataFrame, hot_rows: int = HOT_ROWS, n_slices: int | None = None, count_on: DataFrame | None = None,
                      carry: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """F0-F19: everything that needs the vendor's own history only.

    ``carry`` may add what is known of rows that are no longer at hand to the measures. Rows without a vendor or a time have no history.
    """
    m = measures(df, hot_rows, n_slices, count_on)
    if carry is not None:
        m = carry(m)
    amount = _money(F.col("cents"))
    avg_prior = _ratio(F.col("sum_prior"), F.col("n_prior") * F.lit(100.0))
    avg30 = _ratio(F.col("sum30"), F.col("n30") * F.lit(100.0))
    n7, n30 = F.col("n7"), F.col("n30")
    feats = {
        "amount_log": F.log1p(F.greatest(amount, F.lit(0.0))),
        "vendor_30d_velocity": _money(F.col("sum30")),
        "days_since_last_invoice": F.coalesce(
            F.floor((F.col("us") - F.col("prev_us")) / F.lit(1_000_000)) / F.lit(86400.0), F.lit(0.0)),
        "is_weekend_payment": is_weekend("ts").cast("double"),
        "amount_vs_vendor_avg": amount / (F.coalesce(avg_prior, amount) + 1.0),
        "invoice_count_7d": n7,
        "invoice_count_30d": n30,
        "rolling_7d_sum": _money(F.col("sum7")),
        "max_invoices_7d_window": F.coalesce(F.col("max7"), F.lit(0)),
        "consecutive_small_invoices": F.col("small_run"),
        "amount_std_30d": F.when(n30 >= 2, F.col("std30")).otherwise(0.0),
        "is_round_amount": is_round(F.col("cents")).cast("double"),
        "invoice_count_24h": F.col("n24"),
        "invoice_count_48h": F.col("n48"),
        "invoice_sum_48h": _money(F.col("sum48")),
        "approval_limit_proximity": near_limit(F.col("cents")).cast("double"),
        "freq_change_rate": n7 / (n30 / F.lit(4.0) + 0.1),
        "amount_zscore_30d": F.when(n30 >= 2, (amount - avg30) / (F.col("std30") + 1.0)).otherwise(0.0),
        "invoice_spacing_cv": F.when(
            (F.col("n_prior") >= 3) & (F.col("gap_n") >= 2) & (F.col("gap_avg") > 0),
            F.col("gap_std") / (F.col("gap_avg") + 0.1)).otherwise(0.0),
        "small_invoice_cluster_14d": F.col("small14"),
    }
    return m.select(*df.columns, F.coalesce(avg_prior, F.lit(0.0)).alias("vendor_avg_amount"),
                    *[c.cast("double").alias(k) for k, c in feats.items()])


def agency_amount_mean(df: DataFrame) -> DataFrame:
    """Mean amount per agency: one small row per agency after a map-side combine."""
    return df.filter(F.col("agency").isNotNull()).groupBy("agency").agg(
        _ratio(F.sum("cents"), F.count("cents") * F.lit(100.0)).alias("agency_mean"))


def agency_peers(features: DataFrame) -> DataFrame:
    """Per agency the mean amount and the mean over vendors of each vendor's mean 30-day count, in one pass."""
    per_vendor = features.filter(F.col("agency").isNotNull()).groupBy("agency", "vendor_id").agg(
        F.avg("invoice_count_30d").alias("rate"), F.sum("cents").alias("cents"), F.count("cents").alias("n"))
    return per_vendor.groupBy("agency").agg(
        F.avg("rate").alias("agency_rate"), _ratio(F.sum("cents"), F.sum("n") * F.lit(100.0)).alias("agency_mean"))


def _vs_mean() -> Column:
    return F.coalesce(_money(F.col("cents")) / (F.col("agency_mean") + 1.0), F.lit(1.0)).alias("amount_vs_category_avg")


def _vs_rate() -> Column:
    return (F.col("invoice_count_30d") / (F.coalesce("agency_rate", F.lit(1.0)) + 0.1)).alias("invoice_freq_vs_category")


def amount_vs_agency(df: DataFrame) -> DataFrame:
    """F20; needs no history, only the agency means."""
    return df.join(lookup(agency_amount_mean(df)), "agency", "left").select(*df.columns, _vs_mean())


def frequency_vs_agency(features: DataFrame) -> DataFrame:
    """F21 from the 30-day counts; rows without an agency are compared to a rate of one."""
    return features.join(lookup(agency_peers(features)), "agency", "left").select(*features.columns, _vs_rate())


def feature_matrix(df: DataFrame, hot_rows: int = HOT_ROWS, n_slices: int | None = None, count_on: DataFrame | None = None, hold: Hold = cut) -> DataFrame:
    """All 22 features in their fixed order, next to the key columns. With agencies the result is cheap to read again: the windows are held by ``hold``."""
    if "agency" in df.columns:
        # read twice: for the agencies' peers and for the result
        feats = hold(temporal_features(df, hot_rows, n_slices, count_on))
        feats = feats.join(lookup(agency_peers(feats)), "agency", "left").select(*feats.columns, _vs_mean(), _vs_rate())
    else:
        feats = temporal_features(df, hot_rows, n_slices, count_on).withColumns(
            {"amount_vs_category_avg": F.lit(1.0), "invoice_freq_vs_category": F.lit(1.0)})
    return feats.select(*df.columns, "vendor_avg_amount",
                        *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in FEATURES])


def single_feature_vector(df: DataFrame) -> DataFrame:
    """The 22 values from aggregates the caller supplies as columns; missing ones take their default.

    ``vendor_30d_spend`` and ``vendor_avg_amount`` feed the velocity and the ratio.
    """
    def given(name: str, default: float) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)

    amount = _money(F.col("cents"))
    n7, n30 = given("invoice_count_7d", 0.0), given("invoice_count_30d", 0.0)
    change = given("freq_change_rate", 0.0)
    special = {
        "amount_log": F.log1p(F.greatest(amount, F.lit(0.0))),
        "vendor_30d_velocity": given("vendor_30d_spend", 0.0),
        "is_weekend_payment": is_weekend("ts").cast("double"),
        "amount_vs_vendor_avg": amount / (given("vendor_avg_amount", 0.0) + 1.0),
        "is_round_amount": is_round(F.col("cents")).cast("double"),
        "approval_limit_proximity": near_limit(F.col("cents")).cast("double"),
        "freq_change_rate": F.when(change != 0, change)
        .when(n30 > 0, n7 / (n30 / F.lit(4.0) + 0.1)).otherwise(0.0),
        "amount_vs_category_avg": given("amount_vs_category_avg", 1.0),
        "invoice_freq_vs_category": given("invoice_freq_vs_category", 1.0),
    }
    values = [(special[c] if c in special else given(c, 0.0)).cast("double").alias(c) for c in FEATURES]
    keep = [c for c in df.columns if c not in FEATURES]
    return df.select(*keep, *values)


# ---------------------------------------------------------------------------------------------
# as-of features for rows that wait to be scored

AS_OF = ["invoice_count_30d", "vendor_avg_amount", "amount_std_30d", "invoice_count_7d", "rolling_7d_sum",
         "invoice_count_24h", "invoice_count_48h", "amount_zscore_30d"]


def temporal_as_of(df: DataFrame, hot_rows: int = HOT_ROWS, n_slices: int | None = None) -> DataFrame:
    """the vendor's rows strictly before the reference time; rows of the same time do not count.

    Rows without a vendor or a time get zeros and take no part in the windows. Hot vendors go through the same
    slices as the batch features.
    """
    usable = F.col("vendor_id").isNotNull() & F.col("ts").isNotNull()
    rows = df.filter(usable).withColumn("us", micros("ts"))
    hot = lookup(hot_vendors(df.filter(usable), hot_rows))
    if hot.isEmpty():
        parts = [_as_of_windows(rows)]
    else:
        parts = [_as_of_windows(rows.join(hot, "vendor_id", "left_anti")),
                 _as_of_sweep(rows.join(hot, "vendor_id", "left_semi"), n_slices)]
    stats = reduce(DataFrame.unionByName, parts)
    zero = F.lit(0)
    n30 = F.col("n30")
    out = stats.select(
        *df.columns,
        n30.cast("double").alias("invoice_count_30d"),
        F.when(n30 > 0, _ratio(F.col("s30"), n30 * F.lit(100.0))).otherwise(0.0).alias("vendor_avg_amount"),
        F.coalesce("std30", F.lit(0.0)).alias("amount_std_30d"),
        F.col("n7").cast("double").alias("invoice_count_7d"),
        _money(F.coalesce("s7", zero)).alias("rolling_7d_sum"),
        F.col("n24").cast("double").alias("invoice_count_24h"),
        F.col("n48").cast("double").alias("invoice_count_48h"),
    )
    z = (_money(F.col("cents")) - F.col("vendor_avg_amount")) / F.col("amount_std_30d")
    out = out.withColumn("amount_zscore_30d", F.when(F.col("amount_std_30d") > 0, z).otherwise(0.0))
    bare = df.filter(~usable).select(*df.columns, *[F.lit(0.0).alias(c) for c in AS_OF])
    return out.select(*df.columns, *AS_OF).unionByName(bare)


def _as_of_windows(rows: DataFrame) -> DataFrame:
    """Frames that end one microsecond before the row, so equal times share a result without being joined back."""
    by_time = Window.partitionBy("vendor_id").orderBy("us")
    back = lambda width: by_time.rangeBetween(-width, -1)
    return rows.select(
        *rows.columns,
        F.count("*").over(back(DAY)).alias("n24"), F.count("*").over(back(2 * DAY)).alias("n48"),
        F.count("*").over(back(7 * DAY)).alias("n7"), F.sum("cents").over(back(7 * DAY)).alias("s7"),
        F.count("*").over(back(30 * DAY)).alias("n30"), F.sum("cents").over(back(30 * DAY)).alias("s30"),
        F.stddev_pop(F.col("cents") / F.lit(100.0)).over(back(30 * DAY)).alias("std30"),
    )


def _as_of_sweep(rows: DataFrame, n_slices: int | None) -> DataFrame:
    """One exact row per (vendor, time), running totals over rows and probes, and the result joined back."""
    sq = F.col("cents").cast("decimal(19,0)") * F.col("cents").cast("decimal(19,0)")
    steps = rows.groupBy("vendor_id", "us").agg(
        F.count("*").alias("n"), F.sum("cents").alias("s"), F.sum(sq.cast("decimal(38,0)")).alias("q"))
    widths = {"24": DAY, "48": 2 * DAY, "7": 7 * DAY, "30": 30 * DAY}
    marks = [F.struct(F.col("us").alias("at"), F.lit(1).alias("kind"), F.lit("row").alias("mark"))]
    marks += [F.struct((F.col("us") - w).alias("at"), F.lit(0).alias("kind"), F.lit(m).alias("mark"))
              for m, w in widths.items()]
    is_row = F.col("m.mark") == "row"
    line = steps.select("*", F.explode(F.array(*marks)).alias("m")).select(
        "vendor_id", "us", "m.*", *[F.when(is_row, F.col(c)).otherwise(0).alias(c) for c in ("n", "s", "q")])
    line = running_sums(line, ["vendor_id"], ["at", "kind", "us", "mark"], ["n", "s", "q"], n_slices)
    at = lambda m, c: F.max(F.when(F.col("mark") == m, F.col(f"{c}_before")))
    since = lambda m, c: at("row", c) - at(m, c)
    stats = line.groupBy("vendor_id", "us").agg(
        since("24", "n").alias("n24"), since("48", "n").alias("n48"), since("7", "n").alias("n7"),
        since("7", "s").alias("s7"), since("30", "n").alias("n30"), since("30", "s").alias("s30"),
        since("30", "q").alias("q30"))
    exact = (F.col("n30").cast("decimal(12,0)") * F.col("q30")
             - F.col("s30").cast("decimal(19,0)") * F.col("s30").cast("decimal(19,0)"))
    std = F.when(F.col("n30") > 0, F.sqrt(exact.cast("double")) / F.col("n30") / 100.0)
    return rows.join(stats.withColumn("std30", std).drop("q30"), ["vendor_id", "us"]).select(
        *rows.columns, "n24", "n48", "n7", "s7", "n30", "s30", "std30")
