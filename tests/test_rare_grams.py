"""The rare-gram join and the batched ratio against plain loops."""

import difflib
import random

import pytest

from procspark.functions.matching import ratios
from procspark.operators import rare_grams


def spelled(rnd, n, letters="abcdefghijklmnop ", sizes=(3, 40)):
    """Names with up to four variants each."""
    out = []
    while len(out) < n:
        base = "".join(rnd.choice(letters) for _ in range(rnd.randint(*sizes)))
        for edits in range(rnd.randint(1, 4)):
            text = list(base)
            for _ in range(edits):
                text[rnd.randrange(len(text))] = rnd.choice(["", "x", "qz", rnd.choice(letters)])
            out.append("".join(text) or "a")
    return list(dict.fromkeys(out))


def ratio(a, b):
    return difflib.SequenceMatcher(a=a, b=b).ratio()


@pytest.mark.parametrize("seed", range(4))
def test_batched_ratio(seed):
    rnd = random.Random(seed)
    letters = ["ab", "abcd ", "abcdefghij é한"][seed % 3]
    names = spelled(rnd, 300, letters, (1, 70)) + ["", "a" * 250, "ab" * 120, "x" * 64, "x" * 65]
    left = [rnd.choice(names) for _ in range(1500)] + names
    right = [rnd.choice(names) for _ in range(1500)] + names[::-1]
    assert ratios(left, right).tolist() == pytest.approx([ratio(a, b) for a, b in zip(left, right)], abs=1e-12)
    assert ratios([], []).tolist() == []


@pytest.mark.parametrize("threshold, rare", [(0.88, 64), (0.88, 0), (0.95, 2), (0.7, 3)])
def test_no_pair_is_lost(spark, threshold, rare):
    names = spelled(random.Random(int(threshold * 100) + rare), 260, "abc " if rare else "abcdefgh ", (1, 30)) + ["a", "b", "ab", "ba", "abcab", "abca"]
    names = list(dict.fromkeys(names))
    want = {tuple(sorted((a, b))) for i, a in enumerate(names) for b in names[i + 1:] if max(ratio(a, b), ratio(b, a)) >= threshold}
    found = rare_grams.candidates(spark.createDataFrame([(n,) for n in names], "name string"), "name", threshold, rare, block_rows=7).collect()
    assert len(found) == len({(r.l, r.r) for r in found})
    assert {tuple(sorted((r.l, r.r))) for r in found} >= want and len(want) > 20


def test_names_meet_few_others_whatever_their_number(spark):
    """Pairs that exist before the edit distance, for each name, on a table and on one ten times as large."""
    per = []
    for n in (400, 4000):
        names = spark.createDataFrame([(x,) for x in spelled(random.Random(3), n, sizes=(16, 40))], "name string")
        met = rare_grams.meetings(rare_grams.keyed(names, "name", 0.88), 0.88)
        per.append(met.select("l", "r").distinct().count() / names.count())
    print("pairs met for each name:", per)
    assert per[1] < 40 and per[1] < 4 * per[0] + 5


def test_a_shared_frequent_word_is_no_key(spark):
    """All names end alike; they are joined on what is rare in them."""
    rnd = random.Random(4)
    names = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(14)) + " industries" for _ in range(1500)]
    table = spark.createDataFrame([(x,) for x in names], "name string")
    assert rare_grams.meetings(rare_grams.keyed(table, "name", 0.88), 0.88).select("l", "r").distinct().count() < 0.15 * len(names) * (len(names) - 1) / 2


def test_keys_are_made_in_all_tasks_and_no_side_is_sent_whole(spark):
    """A table of names has few bytes, its keys have many: they neither stay in the task of the names nor are foretold as small."""
    names = spark.createDataFrame([(x,) for x in spelled(random.Random(5), 300, sizes=(16, 30))], "name string").coalesce(1)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert rare_grams.keyed(names, "name", 0.88).rdd.getNumPartitions() == width
    plan = rare_grams.candidates(names, "name", 0.88)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") >= 3  # tiles, and texts of both sides; the one table sent holds the groups of several tiles
