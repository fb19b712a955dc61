import zlib
from collections import defaultdict

import numpy as np
import xxhash
from tokenizers import Tokenizer

import __spark_entry__ as entry_point
from procspark.llm import line_spread, packing, simhash_golay
from procspark.llm.common import tokenizer_path
from tests.llm.conftest import SF

PATH = tokenizer_path("word_bpe_49k.json")


def check_packing(rows, docs, limits):
    tok = Tokenizer.from_file(PATH)
    want = []
    for d in docs:
        ids = np.array(tok.encode(d.text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        for k, at in enumerate(range(0, len(ids), limits.tokens)):
            part = ids[at:at + limits.tokens]
            want.append((d.doc_id, k, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id is not None) == sorted(w for w in want if w[0] is not None)
    assert len(rows) == len(want)
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= limits.tokens and len(parts) <= limits.documents and sum(n * n for _, n in parts) <= limits.attention
    return len(by), sum(w[3] for w in want)


def test_packing_of_the_table(spark):
    rows = entry_point.queries()["op4_best_fit_packing"](spark, SF).collect()
    n, total = check_packing(rows, spark.read.parquet(f"{SF}/documents.parquet").collect(), packing.Limits())
    assert n <= -(-total // 4096) * 1.02 + 1


def test_packing_of_odd_texts_under_every_limit(spark, odd_docs):
    extra = spark.createDataFrame([(100 + i, t) for i, t in enumerate(["<|startoftext|> x<|endoftext|>y", "ＡＢＣ ﬁ Ⅻ", "don't we'll", "a\x85b\xa0c d", "é ́x"])], "doc_id bigint, text string")
    docs = odd_docs.select("doc_id", "text").union(extra)
    for limits in (packing.Limits(64, 3, 1500), packing.Limits(64, 5, 64 * 64, rule="dot"), packing.Limits(4096)):
        if limits.attention < limits.tokens ** 2:
            pieces = packing.tokenize(docs, PATH, tokens=32)
            rows = packing.pack(pieces, limits).collect()
            by = defaultdict(list)
            for r in rows:
                by[r.sequence_id].append(r.length)
            assert all(sum(p) <= 64 and len(p) <= 3 and sum(x * x for x in p) <= 1500 for p in by.values())
            continue
        rows = packing.pack(packing.tokenize(docs, PATH, tokens=limits.tokens), limits).collect()
        check_packing(rows, docs.collect(), limits)
    assert packing.pack(packing.tokenize(docs.limit(0), PATH)).count() == 0


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(3)
    counts = {int(n): int(c) for n, c in zip(rng.integers(1, 500, 80), rng.integers(1, 10**6, 80))}
    table = packing.plan(counts, packing.Limits(500, 20, 500 * 500))
    ranks = defaultdict(int)
    ends = {}
    for n, first, copies, base, _ in table.tolist():
        assert first == ranks[n]
        ends.setdefault(base, 0)
        ends[base] += copies * n
        nxt = [f for m, f, *_ in table.tolist() if m == n and f > first]
        ranks[n] = min(nxt, default=counts[n])
    assert all(ranks[n] == c for n, c in counts.items()) and max(ends.values()) <= 500


def test_odd_lines(spark):
    rows = []
    for i in range(30):
        rows.append((i, f"own line {i} of this document, long enough to be the most of it\n  shared foot \n\nshared foot", f"site{i % 12}", "x"))
        rows.append((100 + i, f"same words everywhere\nsame again\nown {i}", f"site{i % 12}", "x"))
    rows += [(200, None, None, "x"), (201, "", "a", "x"), (None, "shared foot\nnull id keeps its own, longer line", "b", "x"), (0, rows[0][1], "site0", "x"),
             (202, "few sites", "a", "x"), (203, "few sites", "b", "x"), (204, "few sites", "b", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, spread string")
    got = line_spread.strip_boilerplate(df, min_sites=10)
    joined = line_spread.strip_boilerplate(df, min_sites=10, few=0, keep=("spread", "source"))
    assert joined.columns == ["doc_id", "spread", "source", "text", "n_lines", "n_removed"]
    assert sorted(map(str, joined.select(got.columns).collect())) == sorted(map(str, got.collect()))
    assert got.columns == ["doc_id", "text", "n_lines", "n_removed"]
    for few in (0, 100):
        own = line_spread.strip_boilerplate(df.withColumn("n_lines", df.doc_id * 0 - 1), few=few, keep=("n_lines",))
        assert own.columns == ["doc_id", "n_lines", "text", "n_removed"] and {r.n_lines for r in own.collect()} <= {-1, None}
    out = defaultdict(list)
    for r in got.collect():
        out[r.doc_id].append(r)
    assert out[0][0].text == "own line 0 of this document, long enough to be the most of it\n" and out[0][0].n_removed == 2 and len(out[0]) == 2
    assert out[100][0].n_removed == 0 and out[100][0].text == "same words everywhere\nsame again\nown 0"  # mostly spread: a copy
    assert out[None][0].text == "null id keeps its own, longer line" and out[200][0].text == "" and out[202][0].n_removed == 0
    assert got.count() == len(rows)
    assert line_spread.strip_boilerplate(df.limit(0)).count() == 0


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in lowered.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, ids):
    n = len(fps)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    a = np.array(fps, dtype=np.uint64)
    for i in range(n):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1:] ^ a[i]) <= 3) + i + 1:
            root[find(int(j))] = find(i)
    names = {}
    for i in range(n):
        if ids[i] is not None:
            names[find(i)] = min(ids[i], names.get(find(i), ids[i]))
    return [names.get(find(i)) for i in range(n)]


def test_near_duplicates_of_the_table_and_odd_texts(spark, odd_docs):
    for docs, got in ((spark.read.parquet(f"{SF}/documents.parquet"), entry_point.queries()["op6_simhash_near_dedup"](spark, SF)),
                      (odd_docs, simhash_golay.near_duplicates(odd_docs))):
        rows = docs.collect()
        fps = [plain_fingerprint(r.text) for r in rows]
        want = sorted(((r.doc_id, f"{f:016x}", c) for r, f, c in zip(rows, fps, components(fps, [r.doc_id for r in rows]))), key=str)
        assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert simhash_golay.near_duplicates(odd_docs.limit(0)).count() == 0


def test_links_connect_what_three_bits_connect(spark):
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 2**64, 40, dtype=np.uint64)
    fps = set(centre.tolist())
    for c in centre.tolist():
        for _ in range(30):
            x = c
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp bigint")
    want = components(fps, fps)
    for tile in (4096, 8):  # whole keys, and hot keys dealt into tiles
        root = {f: f for f in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for r in simhash_golay.links(df, tile=tile).collect():
            u, v = r.src % 2**64, r.dst % 2**64
            assert bin(u ^ v).count("1") <= 3
            a, b = sorted((find(u), find(v)))
            root[b] = a
        assert [find(f) for f in fps] == want


def test_one_of_each_group_stays(spark, odd_docs):
    kept = simhash_golay.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    every = {r.doc_id: r.component_id for r in simhash_golay.near_duplicates(odd_docs).collect()}
    assert [i for i in ids if i is not None] == sorted({c for i, c in every.items() if c is not None and i == c}, key=str)
