"""Edit fingerprints, centroid clustering and the Merkle manifest against plain loops."""

import math
import random
import zlib
from hashlib import sha256

import numpy as np
import pytest

from procspark.llm import centroid_search, edit_embedding, merkle
from pyspark.sql import functions as F

# --- edit fingerprints ---------------------------------------------------------------------------


def plain_fingerprint(text):
    """Step by step, without tables."""
    points = [ord(c) for c in text]
    if not points:
        return bytes(edit_embedding.SLOTS)
    bits, (classes, bytes_) = edit_embedding.walk_bits(), edit_embedding.character_tables()
    emitted = []
    for p in points:
        while True:
            j = len(emitted)
            emitted.append(p)
            if bits[j % len(bits), classes[p & 0xFFFF]]:
                break
    out = bytearray()
    for steps in edit_embedding.ladders():
        out.append(bytes_[emitted[max(s for s in steps.tolist() if s < len(emitted))] & 0xFFFF])
    return bytes(out)


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        before, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, before + (x != y))
    return row[-1]


def test_walk_and_sample_equal_the_definition():
    rng = random.Random(5)
    for n in (0, 1, 2, 7, 300, 3000):
        text = "".join(rng.choice("abcdefgh é한😀\n") for _ in range(n))
        assert edit_embedding.fingerprint(text.encode()).tobytes() == plain_fingerprint(text)


def test_edit_distance():
    rng = random.Random(6)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in "ab")
        assert edit_embedding.edit_distance(a, b) == plain_edits(a, b)


def test_few_edits_leave_most_slots():
    rng = random.Random(7)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    near, far = [], []
    for _ in range(60):
        text = " ".join(rng.choice(words) for _ in range(300))
        cut = list(text)
        for _ in range(3):
            del cut[rng.randrange(len(cut))]
        near.append(edit_embedding.likeness(*(edit_embedding.fingerprint(t.encode()) for t in (text, "".join(cut)))))
        other = " ".join(rng.choice(words) for _ in range(300))
        far.append(edit_embedding.likeness(*(edit_embedding.fingerprint(t.encode()) for t in (text, other))))
    assert np.mean(near) > 0.85 and max(far) < 0.3 and np.median(near) > 0.9


def want_neighbours(rows):
    """``rows`` in their defined order."""
    out = []
    for k, (number, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        third = len(text) // 3
        edited = text[:len(text) - third] + after[:third]
        own, new, nxt = map(plain_fingerprint, (text, edited, after))
        same = lambda a, b: sum(x == y for x, y in zip(a, b)) / len(a)
        out.append((number, len(text), sha256(edited.encode()).hexdigest(), own.hex(), new.hex(), same(own, new), same(own, nxt)))
    return out


NEIGHBOUR = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@pytest.mark.parametrize("parts", [1, 7])
def test_neighbours_equal_a_plain_loop(spark, parts):
    rng = random.Random(8)
    rows = [(i * 3, "".join(rng.choice("abc de\nfé한") for _ in range(rng.randrange(0, 400)))) for i in range(120)]
    rows[5] = (15, None)
    rows[6] = (18, "")
    got = edit_embedding.with_neighbours(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts))
    want = want_neighbours(sorted(rows, key=lambda r: -r[0]))
    assert sorted(map(tuple, got.select(*NEIGHBOUR).collect())) == sorted(want)


def test_neighbours_of_odd_rows(spark, odd_docs):
    got = edit_embedding.with_neighbours(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(by[5]) == 2 and by[5][0].fingerprint == by[5][1].fingerprint and any(r.near_next == 1 for r in by[5])
    assert by[None][0].n_chars > 0 and by[3][0].fingerprint == by[2][0].fingerprint == "00" * 256 and by[12][0].fingerprint == by[13][0].fingerprint
    one = spark.createDataFrame([(1, "abcdef")], "doc_id bigint, text string")
    assert [tuple(r) for r in edit_embedding.with_neighbours(one).select(*NEIGHBOUR).collect()] == want_neighbours([(1, "abcdef")])
    assert edit_embedding.with_neighbours(one.filter("false")).count() == 0


def test_near_pairs_equal_all_pairs(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(40)]
    for t in texts[:15]:
        cut = list(t)
        for _ in range(2):
            cut[rng.randrange(len(cut))] = "z"
        texts.append("".join(cut))
    rows = [*enumerate(texts), (900, texts[0]), (901, None), (902, ""), (None, texts[1])]
    found = {(r.a, r.b): r.edits for r in edit_embedding.near_pairs(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    near = {}
    for i in range(len(texts)):
        for j in range(i + 1, len(texts)):
            fa, fb = (np.frombuffer(plain_fingerprint(texts[k]), np.uint8) for k in (i, j))
            d = plain_edits(texts[i], texts[j]) if (fa == fb).mean() > 0.5 else 10 ** 6
            if (fa == fb).mean() >= 0.8 and edit_embedding.share_band(fa, fb) and d <= 0.2 * max(len(texts[i]), len(texts[j])):
                near[i, j] = d
    assert found == near and len(near) >= 12


# --- centroid clustering -------------------------------------------------------------------------


def plain_clusters(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [list(v) for _, v in start]

    def place(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        at = [place(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            own = [v for (_, v), a in zip(kept, at) if a == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own)]
    out = [(i, *reversed(place(v))) for i, v in kept]
    per = {}
    for _, n, d in out:
        per[n] = per.get(n, 0) + d
    digest = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, d, per[n], sum(per.values()), digest[n]) for i, n, d in out), key=str)


def vectors(rng, n, spread=0.05):
    middle = rng.normal(size=(12, 64))
    return [(int(i), [float(np.float32(x)) for x in middle[i % 12] + rng.normal(size=64) * spread]) for i in range(n)]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_clusters_equal_plain_loops(spark, kind):
    rows = vectors(np.random.default_rng(3), 150)
    rows += [(1000, None), (1001, rows[0][1][:63]), (1002, [None, *rows[0][1][1:]]), (1003, [math.inf, *rows[0][1][1:]]), (1004, [math.nan] * 64),
             (1005, rows[0][1] + [0.0]), (1006, []), (None, rows[3][1]), rows[7], rows[7], (7, rows[8][1]), (1007, [-0.0005] * 64), (1008, [0.0] * 64)]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], f"vec_id bigint, embedding array<{kind}>, cluster string, distance int").repartition(5)
    got = sorted(map(tuple, centroid_search.clusters(table).collect()), key=str)
    assert got == plain_clusters(rows)


def test_clusters_of_few_and_far_vectors(spark):
    schema = "vec_id bigint, embedding array<double>"
    few = [(1, [1.0] * 64), (2, [-1.0] * 64), (3, [1.0] * 64)]
    far = [(i, [float(x) * 1e5 for x in v]) for i, v in vectors(np.random.default_rng(4), 30)]
    for rows in (few, far):
        assert sorted(map(tuple, centroid_search.clusters(spark.createDataFrame(rows, schema)).collect()), key=str) == plain_clusters(rows)
    assert centroid_search.clusters(spark.createDataFrame([(1, None)], schema)).count() == 0


def test_bounds_never_lose_the_nearest():
    rng = np.random.default_rng(5)
    for k, size in ((1, 3), (8, 3), (40, 2000), (7, 1 << 26)):
        x, c = rng.integers(-size, size + 1, (200, 64)), rng.integers(-size, size + 1, (k, 64))
        c[-1] = c[0]  # a tie
        x[0] = c[0]
        d = ((x[:, None, :] - c[None]).astype(object) ** 2).sum(axis=2)
        which, best = centroid_search.nearest(x, c)
        assert which.tolist() == [min(range(k), key=lambda n: (row[n], n)) for row in d] and best.tolist() == d.min(axis=1).tolist()


# --- Merkle manifest -----------------------------------------------------------------------------


def h(text):
    return sha256(text.encode()).hexdigest()


def told(values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def plain_tree(leaves):
    """All levels."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i:i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def path(levels, at):
    out = []
    for level in levels[:-1]:
        run = at // 3 * 3
        out.append((level[run:at], level[at + 1:run + 3]))
        at //= 3
    return out


def plain_manifest(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r, h(told(r))))
    trees = []
    for source in sorted(by, key=lambda s: (s is not None, (s or "").encode())):
        own = sorted(by[source], key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees.append((own, plain_tree([leaf for _, leaf in own])))
    top = plain_tree([levels[-1][0] for _, levels in trees])
    out = []
    for k, (own, levels) in enumerate(trees):
        for at, (row, leaf) in enumerate(own):
            steps = path(levels, at) + path(top, k)
            text = row[4]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            now = h(told((*row[:4], text)))
            for left, right in steps:
                now = h("".join([*left, now, *right]))
            out.append((row[0], leaf, levels[-1][0], top[-1][0], h("".join("".join(a + b) for a, b in steps)), now, now == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [(1,), (28,), (27, 1, 3, 4), (100, 2, 82, 1, 9, 10), tuple([1] * 30)])
def test_manifest_equals_plain_trees(spark, tmp_path, sizes):
    rng = random.Random(10)
    rows = [(rng.randrange(10 ** 6), f"s{k}" if k else None, "en", i, rng.choice(["a\nb", "a b", "", None, "é\n\n한"])) for k, n in enumerate(sizes) for i in range(n)]
    rows += [rows[0], rows[0], (None, "s1", None, None, "null id"), (None, "", "x", 1, "empty source\n")] if len(sizes) > 2 else []
    data = [(*r, "x", 7) for r in rows]
    schema = "doc_id bigint, source string, lang string, n_chars bigint, text string, digest string, tree int"
    spark.createDataFrame(data, schema).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    import __spark_entry__

    got = __spark_entry__.queries()["op13_merkle_manifest"](spark, str(tmp_path))
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == plain_manifest(rows)


def test_manifest_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, source string, digest string")
    made = merkle.build(none)
    assert made.root is None and merkle.proofs(made).count() == 0


def test_only_every_third_level_is_stored(spark):
    rows = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("digest"))
    made = merkle.build(rows)
    assert [b.count() for b in made.leaves.levels] == [38, 2, 1, 1]  # blocks of 27 over 1000 leaves, 38 nodes, 2 nodes, the root
    assert made.root == plain_tree([r.digest for r in rows.orderBy("doc_id").collect()])[-1][0]
