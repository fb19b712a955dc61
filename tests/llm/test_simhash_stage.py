"""The near-copy stage takes SimHash fingerprints of its shingle sets; what they propose is decided on the sets."""

import random

from procspark.llm import shingle_overlap, simhash_golay
from tests.llm.test_shingle_overlap import plain_groups, plain_set


def test_fingerprint_of_hashes_is_the_majority_of_their_bits():
    text = b"one two three four five six seven eight nine ten"
    h = shingle_overlap.shingles(text, 3)
    assert simhash_golay.fingerprint_of(h) == simhash_golay.fingerprint(text)  # no shingle repeats
    assert simhash_golay.fingerprint_of(h[:0]) == 0


def test_stage_proposes_pairs_by_fingerprints(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(2000)]
    rows = []
    for k in range(12):
        base = rng.choices(words, k=400)
        rows.append((3 * k, " ".join(base)))
        rows.append((3 * k + 1, " ".join([*base[:-1], "other"])))  # one shingle apart
        rows.append((3 * k + 2, " ".join(rng.choices(words, k=400))))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    seen, own = [], shingle_overlap.print_pairs

    def watched(sets, *args):
        pairs = own(sets, *args)
        seen.extend(tuple(sorted(r)) for r in pairs.collect())
        return pairs

    monkeypatch.setattr(shingle_overlap, "print_pairs", watched)
    found = {r.doc_id: r.component_id for r in shingle_overlap.near_copies(docs).collect()}
    assert found == plain_groups(rows)
    node = [shingle_overlap._node(shingle_overlap.shingles(t.encode())) for _, t in rows]
    signed = [n - (1 << 64) if n >> 63 else n for n in node]
    near = {tuple(sorted((signed[3 * k], signed[3 * k + 1]))) for k in range(12)}
    assert near <= set(seen) and len(plain_set(rows[0][1])) == 396
