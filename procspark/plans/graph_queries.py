"""Registered queries: graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procspark.operators import components, graph
from procspark.registry import query
from procspark.sources.tables import SPEND_SQL, spend, table

GRAPH_RISK_CTES = """
edges AS (SELECT vendor_id, coalesce(nullif(agency, ''), 'UNKNOWN') AS agency, count(*) AS weight FROM spend GROUP BY 1, 2),
deg AS (SELECT vendor_id, count(*) AS d, sum(weight) / count(*) AS conc FROM edges GROUP BY 1),
nn AS (SELECT count(DISTINCT vendor_id) + count(DISTINCT agency) AS n FROM edges),
und AS (SELECT 'v:' || vendor_id AS x, 'a:' || agency AS y FROM edges UNION SELECT 'a:' || agency, 'v:' || vendor_id FROM edges),
reach AS (WITH RECURSIVE r(x, y) AS (SELECT x, x FROM und UNION SELECT r.x, u.y FROM r JOIN und u ON r.y = u.x) SELECT * FROM r),
root AS (SELECT x, min(y) AS c FROM reach GROUP BY x),
csize AS (SELECT c, count(*) AS vendors FROM root WHERE x LIKE 'v:%' GROUP BY c),
comp AS (SELECT CAST(substr(x, 3) AS BIGINT) AS vendor_id, vendors, vendors / (SELECT max(vendors) FROM csize) AS cluster_score FROM root JOIN csize USING (c) WHERE x LIKE 'v:%'),
jac AS (SELECT a.vendor_id AS u, b.vendor_id AS v, count(*) AS common FROM edges a JOIN edges b ON a.agency = b.agency AND a.vendor_id <> b.vendor_id GROUP BY 1, 2),
clu AS (SELECT u AS vendor_id, avg(common / (du.d + dv.d - common)) AS clustering FROM jac JOIN deg du ON du.vendor_id = u JOIN deg dv ON dv.vendor_id = v GROUP BY u),
seen AS (SELECT DISTINCT vendor_id, agency, date_trunc('week', ts) AS wk FROM spend),
co AS (SELECT vendor_id, CAST(sum(n - 1) AS BIGINT) AS co_count FROM seen JOIN (SELECT agency, wk, count(*) AS n FROM seen GROUP BY 1, 2) USING (agency, wk) WHERE n > 1 GROUP BY 1),
graph_risk AS (
  SELECT d.vendor_id, round(greatest(0.0, least(1.0, 0.30 * conc / greatest(1.0, (SELECT max(conc) FROM deg)) + 0.20 * cluster_score
    + 0.15 * least(2.0 * d / ((SELECT n FROM nn) - 1), 1.0) + 0.20 * coalesce(clustering, 0) + 0.15 * coalesce(co_count / (SELECT max(co_count) FROM co), 0))), 4) AS graph_risk_score
  FROM deg d JOIN comp USING (vendor_id) LEFT JOIN clu USING (vendor_id) LEFT JOIN co USING (vendor_id))"""
WITH_GRAPH = "WITH " + SPEND_SQL + "," + GRAPH_RISK_CTES


def rows(spark: SparkSession, sf: str) -> DataFrame:
    return spend(spark, sf, agency=True).select("vendor_id", "agency", "ts")


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.bipartite_edges(rows(spark, sf))



@query("bipartite_edges", WITH_GRAPH + " SELECT * FROM edges")
def _(spark, sf):
    return edges(spark, sf)


@query("degree_centrality", WITH_GRAPH + """ SELECT vendor_id, round(d / ((SELECT n FROM nn) - 1), 6) AS centrality,
  round(least(2.0 * d / ((SELECT n FROM nn) - 1), 1.0), 6) AS degree_score FROM deg""")
def _(spark, sf):
    return graph.degree_centrality(edges(spark, sf)).select(
        "vendor_id", F.round("centrality", 6).alias("centrality"), F.round("degree_score", 6).alias("degree_score"))


@query("component_size", WITH_GRAPH + " SELECT vendor_id, vendors, cluster_score FROM comp")
def _(spark, sf):
    return graph.component_size(edges(spark, sf))


@query("bipartite_clustering", WITH_GRAPH + " SELECT vendor_id, round(coalesce(clustering, 0), 6) AS clustering FROM deg LEFT JOIN clu USING (vendor_id)")
def _(spark, sf):
    return graph.bipartite_clustering(edges(spark, sf)).withColumn("clustering", F.round("clustering", 6))


@query("co_occurrence", WITH_GRAPH + " SELECT vendor_id, co_count, round(co_count / (SELECT max(co_count) FROM co), 6) AS co_score FROM co")
def _(spark, sf):
    return graph.co_occurrence(rows(spark, sf)).withColumn("co_score", F.round("co_score", 6))


@query("concentration", WITH_GRAPH + """ SELECT vendor_id, round(conc, 6) AS concentration,
  round(conc / greatest(1.0, (SELECT max(conc) FROM deg)), 6) AS conc_score FROM deg""")
def _(spark, sf):
    return graph.concentration(edges(spark, sf)).select("vendor_id", F.round("concentration", 6).alias("concentration"),
                                                        F.round("conc_score", 6).alias("conc_score"))


@query("graph_risk_score", WITH_GRAPH + " SELECT vendor_id, graph_risk_score FROM graph_risk")
def _(spark, sf):
    return graph.graph_risk_score(rows(spark, sf))


@query("graph_summary", WITH_GRAPH + """ SELECT count(*) AS n_vendors, round(avg(graph_risk_score), 4) AS mean_risk, round(max(graph_risk_score), 4) AS max_risk,
  count(*) FILTER (WHERE graph_risk_score > 0.6) AS high_risk FROM graph_risk""")
def _(spark, sf):
    return graph.graph_summary(graph.graph_risk_score(rows(spark, sf)))


# most vendors serve every nation; customers and their order groups give sets that differ
CUSTOMER_SQL = """WITH edges AS (SELECT DISTINCT o_custkey AS vendor_id, o_orderpriority || (o_orderkey % 37) AS agency FROM orders),
deg AS (SELECT vendor_id, count(*) AS d FROM edges GROUP BY 1),
jac AS (SELECT a.vendor_id AS u, b.vendor_id AS v, count(*) AS common FROM edges a JOIN edges b ON a.agency = b.agency AND a.vendor_id <> b.vendor_id GROUP BY 1, 2)
SELECT du.vendor_id, round(coalesce(avg(common / (du.d + dv.d - common)), 0), 6) AS clustering FROM deg du LEFT JOIN jac ON u = du.vendor_id
LEFT JOIN deg dv ON dv.vendor_id = v GROUP BY 1"""


@query("bipartite_clustering_customers", CUSTOMER_SQL)
def _(spark, sf):
    df = table(spark, sf, "orders").select(F.col("o_custkey").alias("vendor_id"),
                                           F.concat("o_orderpriority", F.col("o_orderkey") % 37).alias("agency"))
    return graph.bipartite_clustering(graph.bipartite_edges(df)).withColumn("clustering", F.round("clustering", 6))


@query("connected_components", """
WITH e AS (SELECT 's:' || s_suppkey AS node, s_nationkey // 3 AS g FROM supplier UNION SELECT 'n:' || n_nationkey, n_nationkey // 3 FROM nation)
SELECT node, min(node) OVER (PARTITION BY g) AS component FROM e""")
def _(spark, sf):
    """Suppliers hang on nations, and nations on the next one of their group of three."""
    s = table(spark, sf, "supplier").select(F.concat(F.lit("s:"), "s_suppkey").alias("src"), F.concat(F.lit("n:"), "s_nationkey").alias("dst"))
    k = F.col("n_nationkey")
    n = table(spark, sf, "nation").select(
        F.concat(F.lit("n:"), k).alias("src"),
        F.concat(F.lit("n:"), F.when((k % 3 == 2) | (k == 24), k).otherwise(k + 1)).alias("dst"))
    return components.connected_components(s.unionByName(n))


def awards(spark: SparkSession, sf: str) -> DataFrame:
    return spend(spark, sf, agency=True, category=True).select(
        F.col("vendor_id").cast("string").alias("vendor"), F.col("agency").alias("buyer"), "category")


REL_SQL = "WITH " + SPEND_SQL + """, vb AS (SELECT 'vendor:' || vendor_id AS src, 'buyer:' || agency AS dst, count(*) AS weight FROM spend GROUP BY 1, 2),
bc AS (SELECT 'buyer:' || agency AS src, 'category:' || category AS dst, count(*) AS weight FROM spend GROUP BY 1, 2),
vv AS (SELECT a.src AS src, b.src AS dst, count(*) AS weight FROM vb a JOIN vb b ON a.dst = b.dst AND a.src < b.src GROUP BY 1, 2)"""


@query("relationship_edges", REL_SQL + """ SELECT *, 'vendor_buyer' AS relation FROM vb UNION ALL SELECT *, 'buyer_category' FROM bc UNION ALL SELECT *, 'shared_buyer' FROM vv""")
def _(spark, sf):
    return graph.relationship_edges(awards(spark, sf))


@query("shared_buyer_classes", REL_SQL + """, sets AS (SELECT src AS vendor, string_agg(dst, '|' ORDER BY dst) AS buyers, count(*) AS degree FROM vb GROUP BY 1),
cls AS (SELECT buyers, min(vendor) AS class, count(*) AS size, any_value(degree) AS degree FROM sets GROUP BY 1),
own AS (SELECT class, size, dst AS buyer FROM cls JOIN vb ON src = class)
SELECT a.class AS l_class, b.class AS r_class, count(*) AS weight, a.size AS l_size, b.size AS r_size FROM own a JOIN own b ON a.buyer = b.buyer AND a.class < b.class GROUP BY 1, 2, 4, 5
UNION ALL SELECT class, class, degree, size, size FROM cls WHERE size > 1""")
def _(spark, sf):
    """The shared-buyer edges as links between classes of vendors with equal buyers."""
    return graph.shared_buyer_classes(graph.award_edges(awards(spark, sf)))[1]


@query("repeated_awards", REL_SQL + """ SELECT 'REPEATED_AWARDS' AS signal, least(weight / 20.0, 1.0) AS score,
  src || ' repeatedly awarded by ' || dst || ' (' || weight || ' records)' AS details FROM vb WHERE weight >= 5""")
def _(spark, sf):
    return graph.repeated_awards(graph.award_edges(awards(spark, sf)))


@query("tight_clusters", REL_SQL + """, und AS (SELECT src AS x, dst AS y FROM vb UNION SELECT dst, src FROM vb UNION SELECT src, dst FROM bc UNION SELECT dst, src FROM bc),
reach AS (WITH RECURSIVE r(x, y) AS (SELECT x, x FROM und UNION SELECT r.x, u.y FROM r JOIN und u ON r.y = u.x) SELECT * FROM r),
root AS (SELECT x, min(y) AS c FROM reach GROUP BY x),
s AS (SELECT c, count(*) AS n, count(*) FILTER (WHERE x LIKE 'vendor:%') AS v, count(*) FILTER (WHERE x LIKE 'buyer:%') AS b FROM root GROUP BY c)
SELECT 'TIGHT_CLUSTER' AS signal, least((v + b) / 25.0, 1.0) AS score, 'cluster vendors=' || v || ' buyers=' || b AS details FROM s WHERE n >= 12 AND v >= 4 AND b >= 2""")
def _(spark, sf):
    return graph.tight_clusters(graph.award_edges(awards(spark, sf)))


LEVELS = 7  # longer shortest paths than these graphs have
_LEVEL = """, lv{k} AS (SELECT l.s, e.b AS t, sum(l.paths) AS paths FROM lv{j} l JOIN adj e ON l.t = e.a JOIN dist d ON d.s = l.s AND d.t = e.b AND d.d = {k} GROUP BY 1, 2)"""
# shortest paths counted level by level, then the share of each node in those of every pair
BETWEEN_SQL = """, adj AS (SELECT src AS a, dst AS b FROM vb UNION SELECT dst, src FROM vb UNION SELECT src, dst FROM bc UNION SELECT dst, src FROM bc
  UNION SELECT src, dst FROM vv UNION SELECT dst, src FROM vv),
walks AS (WITH RECURSIVE w(s, t, d) AS (SELECT DISTINCT a, a, 0 FROM adj UNION SELECT w.s, e.b, w.d + 1 FROM w JOIN adj e ON w.t = e.a WHERE w.d < """ + str(LEVELS) + """) SELECT * FROM w),
dist AS (SELECT s, t, min(d) AS d FROM walks GROUP BY 1, 2),
lv0 AS (SELECT s, t, 1.0::DOUBLE AS paths FROM dist WHERE d = 0)""" + "".join(_LEVEL.format(k=k, j=k - 1) for k in range(1, LEVELS + 1)) + """,
sp AS (""" + " UNION ALL ".join(f"SELECT s, t, {k} AS d, paths FROM lv{k}" for k in range(LEVELS + 1)) + """),
part AS (SELECT x.t AS node, sum(x.paths * y.paths / st.paths) AS b FROM sp x JOIN sp y ON x.t = y.s JOIN sp st ON st.s = x.s AND st.t = y.t AND st.d = x.d + y.d
  WHERE x.d > 0 AND y.d > 0 GROUP BY 1),
n AS (SELECT count(DISTINCT a) AS n FROM adj),
btw AS (SELECT DISTINCT a AS node, coalesce(part.b, 0.0) / greatest((n - 1) * (n - 2), 1) AS betweenness FROM adj LEFT JOIN part ON node = a, n)"""


@query("betweenness", REL_SQL + BETWEEN_SQL + " SELECT node, round(betweenness, 8) AS betweenness FROM btw")
def _(spark, sf):
    return graph.betweenness(graph.award_edges(awards(spark, sf))).select("node", F.round("betweenness", 8).alias("betweenness"))


# five buyers with vendors and a category of their own; one vendor sells to all of them
BRIDGE_SQL = """WITH spend AS (SELECT l_suppkey AS vendor_id, 'b' || CASE WHEN l_suppkey = 0 THEN l_orderkey % 5 ELSE l_suppkey % 5 END AS agency,
  'c' || CASE WHEN l_suppkey = 0 THEN l_orderkey % 5 ELSE l_suppkey % 5 END AS category FROM lineitem), """ + REL_SQL[REL_SQL.index("vb AS"):]
UNUSUAL_SQL = """SELECT 'UNUSUAL_CONNECTION' AS signal, round(least(betweenness * 2.5, 1.0), 8) AS score,
  node || ' has high betweenness centrality (' || format('{:.3f}', betweenness) || ')' AS details FROM btw WHERE node LIKE 'vendor:%' AND betweenness >= 0.18"""


def bridged(spark: SparkSession, sf: str) -> DataFrame:
    k = F.when(F.col("l_suppkey") == 0, F.col("l_orderkey") % 5).otherwise(F.col("l_suppkey") % 5)
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("vendor"), F.concat(F.lit("b"), k).alias("buyer"), F.concat(F.lit("c"), k).alias("category"))


@query("unusual_connections", BRIDGE_SQL + BETWEEN_SQL + UNUSUAL_SQL)
def _(spark, sf):
    found = graph.unusual_connections(graph.award_edges(bridged(spark, sf)))
    return found.withColumn("score", F.round("score", 8))


@query("detect_signals", BRIDGE_SQL + BETWEEN_SQL + """, und AS (SELECT a AS x, b AS y FROM adj),
reach AS (SELECT DISTINCT s AS x, t AS y FROM dist),
root AS (SELECT x, min(y) AS c FROM reach GROUP BY x),
z AS (SELECT c, count(*) AS n, count(*) FILTER (WHERE x LIKE 'vendor:%') AS v, count(*) FILTER (WHERE x LIKE 'buyer:%') AS b FROM root GROUP BY c)
""" + UNUSUAL_SQL + """
UNION ALL SELECT 'TIGHT_CLUSTER', round(least((v + b) / 25.0, 1.0), 8), 'cluster vendors=' || v || ' buyers=' || b FROM z WHERE n >= 12 AND v >= 4 AND b >= 2
UNION ALL SELECT 'REPEATED_AWARDS', round(least(weight / 20.0, 1.0), 8), src || ' repeatedly awarded by ' || dst || ' (' || weight || ' records)' FROM vb WHERE weight >= 5""")
def _(spark, sf):
    return graph.detect_signals(bridged(spark, sf)).withColumn("score", F.round("score", 8))
