import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from procspark.llm import lm_maxent
from tests.llm.conftest import SF


def tokens(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    return [*[w for w in lowered.split(" ") if w], None]


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2


def base(docs):
    counts = Counter(w for i, t in docs if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    return [(i, held(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t))) for i, t in docs]


def same(got, want):
    key = lambda r: (str(r[0]), *r[1:5], round(r[5], 6))
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-9)


def test_base_counts_and_held_out_gain(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = entry_point.queries()["op9_lm_scoring"](spark, SF).collect()
    same([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows], base(docs))
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) + 0.03 * sum(r.n_tokens for r in out)
    assert all(math.isfinite(r.score) and r.score <= 0 for r in rows)


def test_rare_words_are_joined_with_the_same_result(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    one = {r.doc_id: r for r in lm_maxent.score_texts(docs, shape=lm_maxent.Shape(rounds=1)).collect()}
    two = {r.doc_id: r for r in lm_maxent.score_texts(docs, shape=lm_maxent.Shape(rounds=1, frequent=50)).collect()}
    same([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in two.values()],
         [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in one.values()])


def test_probabilities_of_all_words_add_up_to_one(spark):
    """After any history: all known words, the end, and one part for unseen words in each class that has words of its own suffix."""
    rng = np.random.default_rng(4)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["aa", "bb", "cc", "dd", "ee", "ff"], 8))) for i in range(60)], "doc_id bigint, text string")
    shape = lm_maxent.Shape(heads=2, rounds=1)
    words, v = lm_maxent._learn_counts(docs.filter("crc32(cast(cast(doc_id as string) as binary)) % 7 != 2").select("text"), shape)
    assert words.count() == v.distinct and v.class_total.sum() == v.total and v.class_distinct.sum() == v.distinct
    weights = rng.normal(size=(shape.rows, shape.classes)).astype(np.float32)
    words = lm_maxent.words_of(pa.RecordBatch.from_arrays([pa.array(["aa bb zz"])], names=["text"]))
    rows, *_ = lm_maxent._tokens(words, v.classes(words.hash, words.suffix), shape)
    p = np.exp(lm_maxent._log_softmax(weights, rows).astype(float))
    within = (v.class_total + v.class_distinct + 1) / (v.class_total + v.class_distinct + 1)  # known words and the unseen part
    assert np.allclose((p * within).sum(axis=1), 1, atol=1e-5)


def test_words_from_bytes():
    texts = [None, "", "  Ab\tcd, ", "x", "y", "é\x1cü \x0b" + "Q" * 200 + " q", " ", "tail.,;:!?!!", "\n\nend"]
    words = lm_maxent.words_of(pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"]))
    assert words.sizes.tolist() == [len(tokens(t)) - 1 for t in texts]
    flat = [w for t in texts for w in tokens(t)[:-1]]
    again = lm_maxent.words_of(pa.RecordBatch.from_arrays([pa.array([" ".join(flat[::-1])])], names=["text"]))
    assert again.hash.tolist() == words.hash.tolist()[::-1] and again.suffix.tolist() == words.suffix.tolist()[::-1]
    assert len(set(words.hash.tolist())) == len(set(flat))


def test_odd_texts(spark, odd_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    rows = lm_maxent.score_texts(odd_docs).collect()
    same([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows], base(docs))
    again = [r.score for r in rows if r.doc_id == 5]
    assert len(again) == 2 and again[0] == again[1]
    assert lm_maxent.score_texts(odd_docs.limit(0)).count() == 0
    alone = spark.createDataFrame([(i, "one two") for i in range(30) if held(i)], "doc_id bigint, text string")  # nothing to train on
    assert {(r.n_known, r.train_tokens, r.base_score) for r in lm_maxent.score_texts(alone).collect()} == {(0, 0, 0.0)}


def test_probabilities_of_words_in_context_add_up_to_one(spark):
    """Both factors by their own weights: all frequent words, the rare ones of each class by their counts, one part for unseen words, the end."""
    rng = np.random.default_rng(5)
    names = [f"w{i}{end}" for i in range(30) for end in ("ing", "ed", "ly")]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(names, 20, p=np.arange(1, 91) / 4095))) for i in range(80)], "doc_id bigint, text string")
    shape = lm_maxent.Shape(heads=2, rounds=1, frequent=100)
    words, v = lm_maxent._learn_counts(docs.select("text"), shape)
    counts = {np.int64(r.w).view(np.uint64): r.c for r in words.collect()}
    assert 5 < len(v.hashes) < len(counts) - 5  # some in the trees, some at the leaves of the rest
    weights, inner = rng.normal(size=(shape.rows, shape.classes)).astype(np.float32), rng.normal(size=shape.inner).astype(np.float32)
    one = lm_maxent.words_of(pa.RecordBatch.from_arrays([pa.array([" ".join(names)])], names=["text"]))
    known = np.array([counts.get(h, 0) for h in one.hash])
    cls, found = v.classes(one.hash, one.suffix), v.find(one.hash)
    leaf, tail = v.leaves(found, cls), found < 0
    context = lm_maxent.words_of(pa.RecordBatch.from_arrays([pa.array(["w1ing w2ed w9ly"])], names=["text"]))
    rows, _, _, _, features = lm_maxent._tokens(context, v.classes(context.hash, context.suffix), shape)
    for t in range(len(rows)):
        p = np.exp(lm_maxent._log_softmax(weights, rows[t:t + 1])[0].astype(float))
        after = lambda leaves, kinds: np.exp(lm_maxent._log_inner(v.trees, inner, np.repeat(features[:, t:t + 1], len(leaves), axis=1), leaves, kinds, shape))  # noqa: B023, E731
        within = after(leaf, cls)
        within[tail] *= known[tail] / v.trees.rest_total[cls[tail]]  # c of c + 1; the ones over belong to all that was smoothed
        smooth = np.array([np.sum(tail & (known > 0) & (cls == k)) + 1 for k in range(shape.classes)])
        rest = after(v.trees.rest, np.arange(shape.classes)) * np.where(v.trees.rest >= 0, smooth / np.maximum(v.trees.rest_total, 1), 0)
        assert np.isclose(p[0] + (p[cls] * within)[known > 0].sum() + (p * rest).sum(), 1, atol=1e-4)


def test_context_tells_words_of_one_class_apart(spark):
    """Words with equal endings and equal counts: only what stands before them differs."""
    rows = [(i, " ".join(["red going blue doing"] * 10)) for i in range(300)]
    free = next(i for i in range(1000, 1100) if held(i))
    shape, score = lm_maxent.Shape(heads=0, step=256, inner_step=256), {}
    for text in ("red going", "red doing", "blue going", "blue doing"):
        docs = spark.createDataFrame([*rows, (free, text)], "doc_id bigint, text string")
        score[text] = lm_maxent.score_texts(docs, shape=shape).filter(F.col("doc_id") == free).first().score
    assert score["red going"] > score["red doing"] + 0.2 and score["blue doing"] > score["blue going"] + 0.2
