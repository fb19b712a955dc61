import difflib
import random

import pytest

from procspark.operators import entity

WORDS = ["alpha", "beta", "gamma", "delta", "metal", "works", "north", "south", "steel", "supply"]


def names(seed, n=90):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        text = list(" ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 4))))
        for _ in range(rnd.randint(0, 2)):
            i = rnd.randrange(len(text))
            text[i] = rnd.choice(["", "x", text[i] + "y"])
        out.append("".join(text).strip() or "a")
    return out + ["a", "ab", "abc", "abd", "b"]


def frame(spark, items):
    return spark.createDataFrame([(i, t) for i, t in enumerate(items)], "place int, name string")


def ratio(a, b):
    return difflib.SequenceMatcher(a=a, b=b).ratio()


@pytest.mark.parametrize("seed", range(3))
def test_no_match_is_missed(spark, seed):
    clean = [(r.clean, r.ord) for r in entity.clean_names(frame(spark, names(seed)), "name", "place").orderBy("ord").collect()]
    want = {(a, b) for i, (a, _) in enumerate(clean) for b, _ in clean[i + 1:] if ratio(a, b) >= 0.88}
    df = entity.clean_names(frame(spark, names(seed)), "name", "place")
    got = {(r.a, r.b): r.score for r in entity.scored_pairs(df).collect() if r.score >= 0.88}
    assert set(got) == want and all(s == pytest.approx(ratio(a, b)) for (a, b), s in got.items())
    assert {(r.a, r.b) for r in entity.candidate_pairs(df, block_rows=5).collect()} >= want


@pytest.mark.parametrize("seed", range(3))
def test_clusters_equal_the_greedy_loop(spark, seed):
    items = names(seed, 120)
    df = frame(spark, items)
    clean = [r.clean for r in entity.clean_names(df, "name", "place").orderBy("ord").collect()]
    leaders, want = [], {}
    for c in clean:
        want[c] = next((x for x in leaders if ratio(c, x) >= 0.88), c)
        if want[c] == c:
            leaders.append(c)
    got = {r.clean: r.leader for r in entity.cluster_vendors(df, "name", "place").collect()}
    assert got == want


def test_spellings_map_to_one_id(spark):
    rows = entity.vendor_mapping(frame(spark, ["ABC Ltd", "ABC Pvt Ltd", "A.B.C Limited", "ABC"]), "name", "place").collect()
    by_name = {r.name: r for r in rows}
    assert by_name["ABC Ltd"].canonical_id == by_name["ABC Pvt Ltd"].canonical_id == by_name["ABC"].canonical_id
    assert by_name["A.B.C Limited"].canonical_name == "a b c"


def test_copies_are_counted_not_paired(spark):
    rows = entity.pairwise_matches(frame(spark, ["Foo Ltd", "FOO Inc", "foo"]), "name", "place").collect()
    assert [(r.a, r.b, r.score, r.a_variants, r.b_variants) for r in rows] == [("foo", "foo", 1.0, 3, 3)]
