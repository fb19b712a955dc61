"""Registered queries: evaluation, forest, second stage, augmentation, entity resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procspark.operators import augment, classifier, entity, evaluate, forest
from procspark.operators import features as feat
from procspark.plans.audit_queries import SPEND_TEMPORAL, burst_rows, spend_rows
from procspark.plans.case_queries import ATTR_SQL, attributions
from procspark.registry import query
from procspark.session import cut
from procspark.sources.tables import SPEND_SQL, spend, table

# scores and labels by arithmetic on the keys: the label follows the score with noise
SCORED_SQL = """WITH e AS (SELECT s / 1000.0 AS score, CASE WHEN s + (l_partkey * 29) % 700 > 1000 THEN 1 ELSE 0 END AS label, l_returnflag AS type
  FROM (SELECT *, (l_orderkey * 13 + l_partkey * 7 + l_linenumber) % 1000 AS s FROM lineitem))"""
THRESHOLD_VALUES = ", ".join(f"({t!r})" for t in evaluate.THRESHOLDS)
SWEEP_SQL = SCORED_SQL + f""", t(thr) AS (VALUES {THRESHOLD_VALUES}),
c AS (SELECT thr, count(*) FILTER (WHERE score >= thr) AS n, count(*) FILTER (WHERE score >= thr AND label = 1) AS hit, (SELECT sum(label) FROM e) AS pos
      FROM e, t GROUP BY thr),
sweep AS (SELECT round(thr, 2) AS threshold, round(CASE WHEN n = 0 THEN 1.0 ELSE hit / n END, 3) AS "precision", round(CASE WHEN n = 0 THEN 0.0 ELSE hit / pos END, 3) AS recall,
  round(CASE WHEN n = 0 OR hit = 0 THEN 0.0 ELSE 2.0 * hit / (n + pos) END, 3) AS f1 FROM c)"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    s = (F.col("l_orderkey") * 13 + F.col("l_partkey") * 7 + F.col("l_linenumber")) % 1000
    return table(spark, sf, "lineitem").select((s / F.lit(1000.0)).alias("score"),
                                               F.when(s + (F.col("l_partkey") * 29) % 700 > 1000, 1).otherwise(0).alias("label"),
                                               F.col("l_returnflag").alias("type"))


@query("threshold_sweep", SWEEP_SQL + " SELECT * FROM sweep", doubles=["threshold"])
def _(spark, sf):
    return evaluate.threshold_sweep(scored(spark, sf))


@query("optimal_threshold", SWEEP_SQL + ' SELECT * FROM sweep ORDER BY "precision" >= 0.60 DESC, f1 DESC, threshold LIMIT 1', doubles=["threshold"])
def _(spark, sf):
    return evaluate.optimal_threshold(evaluate.threshold_sweep(scored(spark, sf)))


@query("roc_auc", SCORED_SQL + """, r AS (SELECT label, rank() OVER (ORDER BY score) AS r0, count(*) OVER (PARTITION BY score) AS k FROM e)
SELECT round((sum(r0 + (k - 1) / 2.0) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))), 8) AS roc_auc FROM r""")
def _(spark, sf):
    return evaluate.roc_auc(scored(spark, sf)).select(F.round("roc_auc", 8).alias("roc_auc"))


@query("pr_auc", SCORED_SQL + """, s AS (SELECT score, sum(label) AS p, count(*) AS n FROM e GROUP BY score),
c AS (SELECT score, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS k, p FROM s),
d AS (SELECT p, tp / k AS prec, coalesce(lag(tp / k) OVER (ORDER BY score DESC), 1.0) AS before FROM c)
SELECT round(sum(p * (prec + before) / 2.0) / sum(p), 8) AS pr_auc FROM d""")
def _(spark, sf):
    return evaluate.pr_auc(scored(spark, sf)).select(F.round("pr_auc", 8).alias("pr_auc"))


@query("per_type_summary", SCORED_SQL + """ SELECT type, count(*) AS count, count(*) FILTER (WHERE label = 1 AND score >= 0.5) AS detected,
  round(count(*) FILTER (WHERE label = 1 AND score >= 0.5) / count(*), 3) AS recall, round(avg(score) FILTER (WHERE label = 1), 4) AS mean_score,
  round(max(score) FILTER (WHERE label = 1), 4) AS max_score FROM e GROUP BY type""")
def _(spark, sf):
    return evaluate.per_type_summary(scored(spark, sf))


@query("attribution_importance", """WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem)
SELECT a.f AS feature, round(avg(abs(a.impact)), 6) AS mean_abs_impact FROM (SELECT unnest(""" + ATTR_SQL + """) AS a FROM t) GROUP BY 1""")
def _(spark, sf):
    rows = spend(spark, sf).withColumn("attributions", attributions())
    return evaluate.attribution_importance(rows).withColumn("mean_abs_impact", F.round("mean_abs_impact", 6))


CANDIDATES = [0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.1]


@query("tune_contamination", SCORED_SQL + f""", t(thr) AS (VALUES {THRESHOLD_VALUES}),
d AS (SELECT -CAST(score AS DOUBLE) AS raw, label FROM e),
o AS (SELECT unnest({CANDIDATES}) AS contamination, unnest(quantile_cont(raw, {CANDIDATES})) AS off FROM d),
n AS (SELECT label, contamination, greatest(0.0, least(1.0, 0.5 - (raw - off))) AS v FROM d, o),
c AS (SELECT contamination, thr, count(*) FILTER (WHERE v >= CAST(thr AS DOUBLE)) AS n, count(*) FILTER (WHERE v >= CAST(thr AS DOUBLE) AND label = 1) AS hit, sum(label) AS pos FROM n, t GROUP BY 1, 2),
s AS (SELECT contamination, round(thr, 2) AS threshold, CASE WHEN n = 0 THEN 1.0 ELSE hit / n END AS p, CASE WHEN n = 0 THEN 0.0 ELSE hit / pos END AS r,
  CASE WHEN n = 0 OR hit = 0 THEN 0.0 ELSE 2.0 * hit / (n + pos) END AS f FROM c),
b AS (SELECT contamination, threshold, round(p, 4) AS "precision", round(r, 4) AS recall, round(f, 4) AS f1 FROM s QUALIFY row_number() OVER (PARTITION BY contamination ORDER BY f DESC, threshold) = 1)
SELECT *, row_number() OVER (ORDER BY f1 DESC, contamination) = 1 AS is_best FROM b""", doubles=["contamination", "threshold"])
def _(spark, sf):
    return evaluate.tune_contamination(scored(spark, sf).withColumn("sample_score", -F.col("score")), CANDIDATES)


SCALED = ["amount_log", "rolling_7d_sum", "invoice_count_30d", "days_since_last_invoice"]


@query("robust_scale", SPEND_TEMPORAL + "\nSELECT tx_id, " + ", ".join(
    f"round(({c} - (SELECT quantile_cont({c}, 0.5) FROM temporal)) / (SELECT quantile_cont({c}, 0.9) - quantile_cont({c}, 0.1) FROM temporal), 5) AS {c}"
    for c in SCALED) + " FROM temporal")
def _(spark, sf):
    # read twice: ranked for the scale, and scaled
    rows = cut(feat.temporal_features(spend_rows(spark, sf), count_on=spend(spark, sf)).select("tx_id", *SCALED))
    return evaluate.robust_scale(rows, SCALED).select("tx_id", *[F.round(c, 5).alias(c) for c in SCALED])


@query("exact_quantiles", """WITH u AS (SELECT 'l_extendedprice' AS feature, l_extendedprice AS v FROM lineitem UNION ALL SELECT 'l_quantity', l_quantity FROM lineitem)
SELECT feature, p AS prob, round(q, 6) AS value FROM (SELECT feature, unnest([0.1, 0.5, 0.9]) AS p, unnest(quantile_cont(v, [0.1, 0.5, 0.9])) AS q FROM u GROUP BY feature)""", doubles=["prob"])
def _(spark, sf):
    return evaluate.exact_quantiles(table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"], [0.1, 0.5, 0.9]).select(
        "feature", "prob", F.round("value", 6).alias("value"))


# ---------------------------------------------------------------------------------------------
# forest and second stage


def scaled_features(spark: SparkSession, sf: str) -> DataFrame:
    # read three times: ranked for the scale, sampled for the trees, scored
    return evaluate.robust_scale(cut(feat.feature_matrix(burst_rows(spark, sf))), feat.FEATURES)


@query("isolation_forest")
def _(spark, sf):
    rows = scaled_features(spark, sf)
    model = forest.fit(rows, "tx_id", feat.FEATURES)
    found = cut(forest.sample_score(rows.select("tx_id", "vendor_id", *feat.FEATURES), model).select("tx_id", "vendor_id", "sample_score"))
    return forest.decision(found, forest.offset_for(found, 0.05)).select("tx_id", "vendor_id", "sample_score", "decision")


@query("forest_sample", """WITH n AS (SELECT *, count(*) OVER () AS rows, md5(concat_ws('|', k, '42')) AS d FROM
  (SELECT l_orderkey || '-' || l_linenumber AS k FROM lineitem)),
p AS (SELECT k, CAST('0x' || substr(d, 1, 10) AS BIGINT) % 2147483647 AS a, CAST('0x' || substr(d, 11, 10) AS BIGINT) % 2147483646 + 1 AS b FROM n
  WHERE CAST('0x' || substr(d, 21, 10) AS BIGINT) < CAST(floor(least(1.0, 2.0 * 300 * 256 / rows) * 1099511627776) AS BIGINT)),
t AS (SELECT k, CAST(tree AS INTEGER) AS tree, (a + tree * b) % 2147483647 AS number FROM p, range(300) AS r(tree)),
c AS (SELECT k, tree, row_number() OVER (PARTITION BY tree ORDER BY number, k) - 1 AS place
  FROM t WHERE number <= floor(least(1.0, 2.0 * 256 / (SELECT count(*) FROM p)) * 2147483647))
SELECT tree, CAST(place AS INTEGER) AS place, k AS "key" FROM c WHERE place < 256""")
def _(spark, sf):
    """The rows every tree of a forest is drawn from."""
    rows = table(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("k"), "l_quantity")
    return forest.sample_rows(rows, "k", ["l_quantity"], forest.TREES, forest.SAMPLE_ROWS, 42)[0].select("tree", "place", "key")


@query("feature_attribution")
def _(spark, sf):
    rows = scaled_features(spark, sf)
    return forest.attributions(rows, forest.fit(rows, "tx_id", feat.FEATURES))


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """History and injected patterns with features; only injected rows carry a label."""
    real = spend(spark, sf).select("vendor_id", "tx_id", "ts", "cents")
    extra = augment.inject_labeled_anomalies(real).select("vendor_id", "tx_id", "ts", "cents", "label", "anomaly_type")
    rows = real.unionByName(extra, allowMissingColumns=True)
    return feat.feature_matrix(rows)


@query("second_stage_classifier")
def _(spark, sf):
    rows = cut(labelled(spark, sf))  # read by the sample, the forest and the scoring
    history, known = rows.filter(F.col("label").isNull()), rows.filter(F.col("label").isNotNull())
    model = forest.fit(history, "tx_id", feat.FEATURES)
    staged = forest.sample_score(known, model).withColumn("forest_score", -F.col("sample_score"))
    cols = ["forest_score", *feat.FEATURES]
    data = cut(classifier.stratified_split(staged.select("tx_id", "label", "anomaly_type", *cols), "tx_id"))
    fitted = classifier.fit(data.filter(~F.col("is_test")), cols, key="tx_id")
    return classifier.probability(data.filter("is_test"), fitted, cols).select("tx_id", "label", "anomaly_type", "probability")


EDGES = {"l_quantity": [float(v) for v in range(5, 50, 5)], "score": [float(v) for v in range(50, 1000, 50)]}
_SOFT = "(CASE WHEN abs({0}) > 0.1 THEN abs({0}) - 0.1 ELSE 0 END)"


def _split_sql(name: str, node: int, where: str) -> str:
    """One node's sums under every edge, and the edge with the largest gain."""
    side = lambda g, h: f"power({_SOFT.format(g)}, 2) / ({h} + 2.0)"
    return f""", {name}_rows AS (SELECT * FROM gh WHERE {where}), {name}_all AS (SELECT sum(g) AS g, sum(h) AS h FROM {name}_rows),
{name}_sides AS (SELECT c, e, sum(CASE WHEN CASE WHEN c = 0 THEN quantity ELSE score END <= e THEN g ELSE 0 END) AS gl,
    sum(CASE WHEN CASE WHEN c = 0 THEN quantity ELSE score END <= e THEN h ELSE 0 END) AS hl FROM {name}_rows, edges GROUP BY c, e),
{name} AS (SELECT {node} AS node, c, e, gl, hl, a.g - gl AS gr, a.h - hl AS hr FROM {name}_sides, {name}_all a WHERE hl >= 5 AND a.h - hl >= 5
  ORDER BY {side('gl', 'hl')} + {side('(a.g - gl)', '(a.h - hl)')} - {side('a.g', 'a.h')} DESC, c, e LIMIT 1)"""


def _below(name: str, sign: str) -> str:
    return f"(SELECT CASE WHEN c = 0 THEN quantity ELSE score END {sign} e FROM {name})"


_LEAF = "round(-0.05 * sign({0}) * " + _SOFT + " / ({1} + 2.0), 6)"


@query("boosting_round", """WITH rows AS (SELECT CAST(l_quantity AS DOUBLE) AS quantity, CAST((l_orderkey * 13 + l_partkey * 7 + l_linenumber) % 1000 AS DOUBLE) AS score,
    CASE WHEN (l_orderkey * 13 + l_partkey * 7 + l_linenumber) % 1000 + 8 * l_quantity + (l_partkey * 29) % 400 > 1200 THEN 1 ELSE 0 END AS label FROM lineitem),
w AS (SELECT (count(*) - sum(label)) / sum(label) AS w FROM rows),
gh AS (SELECT quantity, score, (0.5 - label) * CASE WHEN label = 1 THEN w ELSE 1 END AS g, 0.25 * CASE WHEN label = 1 THEN w ELSE 1 END AS h FROM rows, w),
edges AS (SELECT 0 AS c, CAST(unnest(range(5, 50, 5)) AS DOUBLE) AS e UNION ALL SELECT 1, CAST(unnest(range(50, 1000, 50)) AS DOUBLE))""" +
       _split_sql("s0", 0, "true") + _split_sql("s1", 1, _below("s0", "<=")) + _split_sql("s2", 2, _below("s0", ">")) + f"""
SELECT node, CASE WHEN c = 0 THEN 'l_quantity' ELSE 'score' END AS feature, e AS edge, {_LEAF.format('gl', 'hl')} AS below, {_LEAF.format('gr', 'hr')} AS above
FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2)""", doubles=["below", "above"])
def _(spark, sf):
    """The first tree of the second stage on two columns of all line items: splits and the values of either side."""
    s = (F.col("l_orderkey") * 13 + F.col("l_partkey") * 7 + F.col("l_linenumber")) % 1000
    label = F.when(s + 8 * F.col("l_quantity") + (F.col("l_partkey") * 29) % 400 > 1200, 1).otherwise(0)
    rows = table(spark, sf, "lineitem").select("l_quantity", s.alias("score"), label.alias("label"))
    model = classifier.fit(rows, list(EDGES), rounds=1, depth=2, row_share=1.0, column_share=1.0, edges=EDGES)
    t = model.trees[0]
    found = [(i, model.cols[f], t["cut"][i], round(t["value"][2 * i + 1], 6), round(t["value"][2 * i + 2], 6)) for i, f in enumerate(t["feature"]) if f >= 0]
    return spark.createDataFrame(found, "node int, feature string, edge double, below double, above double")


# the synthetic rows of ``augment`` from the same digests; {src}: vendor_id, cents, ts; {per}: rows per vendor
EXPAND_SQL = """
st AS (SELECT vendor_id, quantile_cont(cents / 100.0, 0.5) AS median, min(ts) AS first_ts FROM {src} GROUP BY vendor_id),
kk AS (SELECT *, unnest(range(1, {per} + 1)) AS k FROM st),
un AS (SELECT *, [CAST('0x' || substr(md5(concat_ws('|', vendor_id, k, 42, p)), 1, 10) AS BIGINT) / 1099511627776.0
                  FOR p IN ['gap', 'day']] AS u,
         [CAST('0x' || substr(md5(concat_ws('|', vendor_id, k, 42, 'amount', p)), 1, 10) AS BIGINT) / 1099511627776.0 FOR p IN ['a', 'b']] AS z FROM kk),
ba AS (SELECT *, sum(CAST(floor(14 + u[1] * 77) AS BIGINT)) OVER (PARTITION BY vendor_id ORDER BY k) AS back FROM un),
da AS (SELECT *, first_ts - to_days(CAST(back AS INTEGER)) AS day0 FROM ba),
ex AS (SELECT vendor_id, concat_ws('-', 'syn', vendor_id, k) AS tx_id,
    CAST(round(greatest(exp(ln(greatest(median, 1.0)) + sqrt(-2.0 * ln(greatest(z[1], 1e-12))) * cos(2.0 * pi() * z[2]) * 0.25), 100.0) * 100) AS BIGINT) AS cents,
    day0 + to_days(CASE WHEN u[2] < 0.95 THEN CASE isodow(day0) WHEN 6 THEN -1 WHEN 7 THEN 1 ELSE 0 END ELSE 0 END) AS ts FROM da)"""


@query("expand_vendor_history", "WITH " + SPEND_SQL + "," + EXPAND_SQL.format(src="spend", per=15) + " SELECT * FROM ex")
def _(spark, sf):
    return augment.expand_vendor_history(spend(spark, sf)).select("vendor_id", "tx_id", "cents", "ts")


@query("inject_labeled_anomalies")
def _(spark, sf):
    return augment.inject_labeled_anomalies(spend(spark, sf))


# a fixed number of orders per customer on average is below the dense limit, so rows are added up to the ceiling
@query("augment_cap", """WITH src AS (SELECT o_custkey AS vendor_id, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderdate AS ts FROM orders),
size AS (SELECT greatest(CAST(floor(count(*) * 0.05) AS BIGINT), 100) AS ceiling, count(*) / count(DISTINCT vendor_id) AS dense, count(DISTINCT vendor_id) AS v FROM src),""" +
       EXPAND_SQL.format(src="src", per="(SELECT greatest(1, ceiling // v) FROM size)") + """,
cutoff AS (SELECT *, row_number() OVER (ORDER BY CAST('0x' || substr(md5(concat_ws('|', tx_id, 42)), 1, 10) AS BIGINT), tx_id) AS r FROM ex)
SELECT vendor_id, tx_id, cents, ts FROM cutoff, size WHERE r <= ceiling AND dense < 15""")
def _(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("vendor_id"), F.col("o_orderkey").cast("string").alias("tx_id"),
                                             F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"), F.col("o_orderdate").alias("ts"))
    return augment.augment_cap(rows).select("vendor_id", "tx_id", "cents", "ts")


# ---------------------------------------------------------------------------------------------
# entity resolution: every supplier under four spellings. The letters follow from a digest of its name, so names of different
# suppliers have little in common and the ratios of one supplier's spellings follow from their lengths.

SPELLINGS_SQL = """WITH h AS (SELECT s_suppkey AS k, translate(md5(s_name), '0123456789abcdef', 'abcdefghijklmnop') AS x FROM supplier),
b AS (SELECT k, substr(x, 1, 8) || ' ' || substr(x, 9, 8) || ' ' || substr(x, 17, 8) AS base FROM h),
clean AS (SELECT k, 0 AS v, base AS name, 2 AS variants FROM b UNION ALL SELECT k, 1, base || 's', 1 FROM b
  UNION ALL SELECT k, 2, substr(base, 1, 11) || '7' || substr(base, 13), 1 FROM b),
pairs AS (SELECT l.name AS a, r.name AS b, l.variants AS a_variants, r.variants AS b_variants,
    CASE WHEN l.v = 0 AND r.v = 1 THEN 52.0 / 53 WHEN l.v = 0 THEN 50.0 / 52 ELSE 50.0 / 53 END AS ratio
  FROM clean l JOIN clean r ON l.k = r.k AND l.v < r.v),
spelled AS (SELECT k, base AS name FROM b UNION ALL SELECT k, upper(base) || ', Ltd.' FROM b
  UNION ALL SELECT k, base || 's & Co' FROM b UNION ALL SELECT k, substr(base, 1, 11) || '7' || substr(base, 13) FROM b)"""


def spellings(spark: SparkSession, sf: str) -> DataFrame:
    x = F.translate(F.md5("s_name"), "0123456789abcdef", "abcdefghijklmnop")
    base = F.concat_ws(" ", F.substring(x, 1, 8), F.substring(x, 9, 8), F.substring(x, 17, 8))
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), base.alias("base"))
    kinds: list[Column] = [F.col("base"), F.concat(F.upper("base"), F.lit(", Ltd.")), F.concat("base", F.lit("s & Co")),
                           F.concat(F.substring("base", 1, 11), F.lit("7"), F.substring("base", 13, 99))]
    return rows.select("k", F.posexplode(F.array(*kinds)).alias("v", "name")).select("name", (F.col("k") * 4 + F.col("v")).alias("place"))


@query("name_similarity", SPELLINGS_SQL + " SELECT a, b, ratio FROM pairs", doubles=["ratio"])
def _(spark, sf):
    names = entity.clean_names(spellings(spark, sf), "name", "place")
    return entity.candidate_pairs(names).withColumn("ratio", entity.name_similarity("a", "b")).select("a", "b", "ratio")


@query("pairwise_matches", SPELLINGS_SQL + """ SELECT a, b, round(ratio, 3) AS score, a_variants, b_variants FROM pairs
UNION ALL SELECT name, name, 1.0, 2, 2 FROM clean WHERE v = 0""", doubles=["score"])
def _(spark, sf):
    return entity.pairwise_matches(spellings(spark, sf), "name", "place")


@query("cluster_vendors", SPELLINGS_SQL + " SELECT c.name AS clean, l.name AS leader FROM clean c JOIN clean l ON c.k = l.k AND l.v = 0")
def _(spark, sf):
    return entity.cluster_vendors(spellings(spark, sf), "name", "place")


@query("vendor_mapping", SPELLINGS_SQL + " SELECT name, base AS canonical_name FROM spelled JOIN b USING (k)")
def _(spark, sf):
    return entity.vendor_mapping(spellings(spark, sf), "name", "place").select("name", "canonical_name")


@query("mapping_with_ids", SPELLINGS_SQL + """, ids AS (SELECT name, base, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('vendor:' || base)) AS h FROM spelled JOIN b USING (k))
SELECT name, base AS canonical_name, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-'
  || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS canonical_id FROM ids""")
def _(spark, sf):
    return entity.vendor_mapping(spellings(spark, sf), "name", "place")
