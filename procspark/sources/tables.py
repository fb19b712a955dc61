"""The audit tables, derived from the star schema that the test data provides.

Each view has a Spark form and the DuckDB text of the same rows (``*_SQL``). Builders take flags so
that a query which does not need a dimension does not pay for joining it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(col: str) -> F.Column:
    """Money as whole cents: sums are exact and do not depend on the order of rows."""
    return F.round(F.col(col) * 100).cast("bigint")


# ---------------------------------------------------------------------------------------------
# transactions

SPEND_SQL = """
spend AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                   CAST(round(l_extendedprice * 100) AS BIGINT)) AS tx_id,
         l_orderkey, l_linenumber, l_partkey,
         l_suppkey AS vendor_id,
         l_extendedprice AS amount,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
         l_shipdate AS ts,
         n_name AS agency,
         p_type AS category,
         p_name AS description,
         CASE l_returnflag WHEN 'A' THEN 'USASPENDING' WHEN 'N' THEN 'CPPP' ELSE 'OCDS' END AS source,
         l_linestatus = 'F' AS is_scored,
         (CAST(round(l_discount * 100) AS BIGINT) * 8 + CAST(round(l_tax * 100) AS BIGINT) * 2) / 100.0
           AS ml_score,
         o_orderstatus, o_orderdate
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN part ON l_partkey = p_partkey
)"""


def spend(spark: SparkSession, sf_dir: str, agency: bool = False, category: bool = False,
          order: bool = False) -> DataFrame:
    """One row per invoice: vendor, money, time; agency / category / order columns on request."""
    df, extra = table(spark, sf_dir, "lineitem"), []
    if agency or order:
        orders = table(spark, sf_dir, "orders").select(
            "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
        if agency:
            # nation is a fixed list of countries, so the broadcast side cannot grow with the data
            where = (
                table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
                .join(F.broadcast(table(spark, sf_dir, "nation").select(
                    "n_nationkey", F.col("n_name").alias("agency"))),
                    F.col("c_nationkey") == F.col("n_nationkey"))
                .select("c_custkey", "agency")
            )
            # an order gets its agency before its lines are joined, so the lines move once
            orders = orders.join(where, orders.o_custkey == where.c_custkey).drop("c_custkey", "o_custkey")
        df = df.join(orders, df.l_orderkey == orders.o_orderkey)
        extra += [c for c in orders.columns if c != "o_orderkey"]
    if category:
        part = table(spark, sf_dir, "part").select(
            "p_partkey", F.col("p_type").alias("category"), F.col("p_name").alias("description"))
        df = df.join(part, df.l_partkey == part.p_partkey)
        extra += ["category", "description"]
    # texts are made of the numbers after the joins: a line moves as numbers
    c = cents("l_extendedprice")
    return df.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", c).alias("tx_id"),
        "l_orderkey", "l_linenumber", "l_partkey",
        F.col("l_suppkey").alias("vendor_id"),
        F.col("l_extendedprice").alias("amount"),
        c.alias("cents"),
        F.col("l_shipdate").alias("ts"),
        F.when(F.col("l_returnflag") == "A", "USASPENDING")
        .when(F.col("l_returnflag") == "N", "CPPP").otherwise("OCDS").alias("source"),
        (F.col("l_linestatus") == "F").alias("is_scored"),
        ((cents("l_discount") * 8 + cents("l_tax") * 2) / F.lit(100.0)).alias("ml_score"),
        *extra,
    )


BURST_SQL = """
burst AS (
  SELECT CAST(event_id AS VARCHAR) AS tx_id, user_id AS vendor_id,
         CAST(round(value * 100) AS BIGINT) * 1000 / 100.0 AS amount,
         CAST(round(value * 100) AS BIGINT) * 1000 AS cents,
         ts, event_type AS agency
  FROM events
)"""


def burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Microsecond-grained invoices for the short windows and the streams."""
    c = cents("value") * 1000
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("tx_id"), F.col("user_id").alias("vendor_id"),
        (c / F.lit(100.0)).alias("amount"), c.alias("cents"), "ts",
        F.col("event_type").alias("agency"))


# ---------------------------------------------------------------------------------------------
# audit cases and action plans

CASES_SQL = SPEND_SQL + """,
cases AS (
  SELECT 'case-' || tx_id AS case_id, tx_id, l_linenumber AS ln, l_orderkey, vendor_id, cents, agency, category, description, ml_score,
         CASE o_orderstatus WHEN 'O' THEN 'OPEN' WHEN 'P' THEN 'IN_REVIEW' ELSE 'CLOSED' END AS status,
         CASE WHEN ml_score >= 0.80 THEN 'HIGH' WHEN ml_score >= 0.60 THEN 'MEDIUM' ELSE 'LOW' END
           AS risk_level,
         ml_score >= 0.80 OR (ml_score >= 0.60 AND l_linenumber % 2 = 0) AS escalated,
         CASE WHEN l_partkey % 4 = 0 THEN 'FRAUD' WHEN l_partkey % 4 = 1 THEN 'SUSPICIOUS'
              WHEN l_partkey % 4 = 2 THEN 'NORMAL' END AS verdict,
         o_orderdate AS created_at, ts AS updated_at
  FROM spend WHERE ml_score >= 0.40
)"""


def cases(spark: SparkSession, sf_dir: str, agency: bool = False, category: bool = False) -> DataFrame:
    score = F.col("ml_score")
    rows = spend(spark, sf_dir, agency=agency, category=category, order=True).filter(score >= 0.40)
    extra = (["agency"] if agency else []) + (["category", "description"] if category else [])
    return rows.select(
        F.concat(F.lit("case-"), "tx_id").alias("case_id"), "tx_id", F.col("l_linenumber").alias("ln"), "l_orderkey",
        "vendor_id", "cents", *extra,
        "ml_score",
        F.when(F.col("o_orderstatus") == "O", "OPEN").when(F.col("o_orderstatus") == "P", "IN_REVIEW")
        .otherwise("CLOSED").alias("status"),
        F.when(score >= 0.80, "HIGH").when(score >= 0.60, "MEDIUM").otherwise("LOW").alias("risk_level"),
        ((score >= 0.80) | ((score >= 0.60) & (F.col("l_linenumber") % 2 == 0))).alias("escalated"),
        F.when(F.col("l_partkey") % 4 == 0, "FRAUD").when(F.col("l_partkey") % 4 == 1, "SUSPICIOUS")
        .when(F.col("l_partkey") % 4 == 2, "NORMAL").alias("verdict"),
        F.col("o_orderdate").alias("created_at"), F.col("ts").alias("updated_at"),
    )


PLANS_SQL = """
plans AS (
  SELECT 'plan-' || o_orderkey AS plan_id, o_orderkey AS case_ref,
         'owner' || (o_custkey % 50) || '@audit.example' AS owner_email,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'COMPLETED'
              WHEN o_orderpriority = '3-MEDIUM' THEN 'IN_PROGRESS'
              WHEN o_orderpriority = '5-LOW' THEN 'CANCELLED' ELSE 'PENDING' END AS status,
         CASE WHEN o_orderkey % 3 = 0 THEN 'RECOVER_FUNDS' WHEN o_orderkey % 3 = 1 THEN 'INVESTIGATE'
              ELSE 'VENDOR_REVIEW' END AS action_type,
         CASE WHEN o_orderkey % 5 <> 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) END AS saved_cents,
         o_orderdate AS created_at, o_orderdate AS updated_at
  FROM orders
)"""


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, priority = F.col("o_orderkey"), F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("plan-"), key).alias("plan_id"), key.alias("case_ref"),
        F.concat(F.lit("owner"), F.col("o_custkey") % 50, F.lit("@audit.example")).alias("owner_email"),
        F.when(priority.isin("1-URGENT", "2-HIGH"), "COMPLETED").when(priority == "3-MEDIUM", "IN_PROGRESS")
        .when(priority == "5-LOW", "CANCELLED").otherwise("PENDING").alias("status"),
        F.when(key % 3 == 0, "RECOVER_FUNDS").when(key % 3 == 1, "INVESTIGATE")
        .otherwise("VENDOR_REVIEW").alias("action_type"),
        F.when(key % 5 != 0, cents("o_totalprice")).alias("saved_cents"),
        F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"),
    )
