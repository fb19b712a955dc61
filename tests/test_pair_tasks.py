"""Pairs of a large group are formed in many tasks, however few bytes its members are."""

from procspark.operators import graph
from procspark.operators.pairs import pair_tiles


def test_blocks_of_a_large_group_meet_in_many_tasks(spark):
    df = spark.range(100).selectExpr("'g' AS g", "concat('m', id) AS m").unionByName(spark.createDataFrame([("h", "x"), ("h", "y")], "g string, m string"))
    pairs = pair_tiles(df, ["g"], "m", block_rows=10)
    assert pairs.rdd.getNumPartitions() == 55  # ten blocks: 45 pairs of two and 10 of one with itself
    got = {(r.g, r.l_m, r.r_m) for r in pairs.collect()}
    want = {("g", *sorted((f"m{i}", f"m{j}"))) for i in range(100) for j in range(i)} | {("h", "x", "y")}
    assert got == want and pairs.count() == len(want)


def test_members_of_a_class_come_out_once_in_order(spark):
    member = spark.range(30).selectExpr("concat('v', id) AS vendor", "if(id < 20, 'v0', 'v20') AS class")
    pairs = spark.createDataFrame([("v0", "v0", 3, 20, 20), ("v0", "v20", 1, 20, 10)], "l_class string, r_class string, weight long, l_size long, r_size long")
    got = sorted((r.src, r.dst, r.weight) for r in graph.expand_classes(member, pairs, block_rows=4).collect())
    low, high = [f"v{i}" for i in range(20)], [f"v{i}" for i in range(20, 30)]
    want = [(*sorted((a, b)), 3) for i, a in enumerate(low) for b in low[:i]] + [(*sorted((a, b)), 1) for a in low for b in high]
    assert got == sorted(want)
