"""The near-copy stage of the pipeline against brute-force similarity of five-word shingles."""

import random

import corpus_pipeline
from procspark.llm import shingle_overlap


def plain_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_groups(rows):
    """Smallest id of each row's group; rows are ``(id, text)`` with distinct ids."""
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                root[find(i)] = find(j)
    first = {}
    for i, (k, _) in enumerate(rows):
        first[find(i)] = min(k, first.get(find(i), k))
    return {k: first[find(i)] for i, (k, _) in enumerate(rows)}


def planted(seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    passage = rng.choices(words, k=30)
    texts = []
    for size in (8, 40, 120, 300, 900):
        for _ in range(6):
            base = rng.choices(words, k=size) + (passage if rng.random() < 0.5 else [])
            texts.append(base)
            for changes in (1, 2, 3, 5, 8, 12):  # both sides of 0.8
                copy = list(base)
                for at in rng.sample(range(len(copy)), min(len(copy), changes)):
                    copy[at] = rng.choice(words)
                texts.append(copy)
    base = rng.choices(words, k=200)
    for _ in range(60):  # one large group
        copy = list(base)
        copy[rng.randrange(200)] = rng.choice(words)
        texts.append(copy)
    texts += [["Few", "words"], ["few", "words"], [], []]
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_stage_keeps_one_of_each_group_of_similar_texts(spark, tmp_path):
    rows = planted()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    want = plain_groups(rows)
    assert 30 < len(set(want.values())) < len(rows) - 60
    kept = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want.values()))


def test_counts_and_tiles_change_nothing(spark):
    rows = planted(6)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for cells, marks, tile in ((64, 512, 8), (1 << 14, 1 << 16, 16)):
        found = shingle_overlap.near_copies(docs, cells=cells, marks=marks, tile=tile).collect()
        assert {r.doc_id: r.component_id for r in found} == plain_groups(rows)


def test_odd_rows(spark, odd_docs):
    found = shingle_overlap.near_copies(odd_docs).collect()
    assert len(found) == odd_docs.count()
    named = {}
    for r in found:
        named.setdefault(r.doc_id, set()).add(r.component_id)
    assert named[2] == named[3] == named[4] == {2} and named[9] == named[5] == {5} and named[13] == {12} and named[6] in ({5}, {6})
    assert shingle_overlap.near_copies(odd_docs.limit(0)).count() == 0
