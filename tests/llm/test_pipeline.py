"""The pipeline against plain loops over the smallest tables, with a few planted documents."""

from collections import defaultdict, namedtuple

import zstandard

import corpus_pipeline
from procspark.llm.packing import Limits
from procspark.llm.quality_bands import Bands
from tests.llm.test_decontaminate import pairs
from tests.llm.test_packing_lines_simhash import check_packing
from tests.llm.test_pages_secrets_quality import measures

SF = "/root/testdata/sf0.001"
Doc = namedtuple("Doc", "doc_id text lang source n_chars")


def one_byte_a_letter(text):
    return bytes(c if c < 128 else 128 + c % 128 for c in map(ord, text))


def good(text, bands=Bands()):
    """The base rules; the lower limits on one byte a letter by code points, the upper ones on UTF-8 bytes by bytes, for the whole and for its chunks."""
    data = (text or "").encode()
    if measures(text)[5] or not data:
        return False
    ratio = lambda b: len(zstandard.ZstdCompressor(level=bands.level).compress(b)) / len(b) if b else 0.0
    low = next(lo for end, lo, _ in bands.whole if len(text) < end)
    high = next(hi for end, _, hi in bands.whole if len(data) < end)
    least, most = bands.chunk_band
    out = 0
    for i in range(0, len(data), bands.chunk) if len(data) >= bands.chunk else ():
        own = data[i:i + bands.chunk]
        c = own if len(own) == bands.chunk else data[-bands.chunk:]  # the last one ends with the text and counts for its own bytes
        out += len(own) * (ratio(one_byte_a_letter(c.decode(errors="ignore"))) < least or ratio(c) > most)
    return low <= ratio(one_byte_a_letter(text)) and ratio(data) <= high and out / len(data) <= bands.chunk_share


def without_spread(docs):
    """Lines of ten or more sites go, unless they are over nine tenths of the text."""
    sites = defaultdict(set)
    bare = lambda line: line.strip(" \t\n\x0b\x0c\r")
    for d in docs:
        for line in d.text.split("\n"):
            sites[bare(line)].add(d.source)
    gone = {line for line, s in sites.items() if line and len(s) >= 10}
    out = []
    for d in docs:
        lines = d.text.split("\n")
        stays = [x for x in lines if bare(x) not in gone]
        if sum(map(len, lines)) - sum(map(len, stays)) <= 0.9 * len(d.text):
            d = d._replace(text="\n".join(stays))
        out.append(d._replace(n_chars=len(d.text)))
    return out


def first_of_groups(docs):
    """All pairs of five-word shingle sets; groups follow from similarities of 0.8 or more, and the smallest id of a group stays."""
    sets = []
    for d in docs:
        words = d.text.encode().lower().split()
        sets.append({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    group = list(range(len(docs)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if both and 5 * both >= 4 * (len(x) + len(sets[j]) - both):
                group[root(i)] = root(j)
    least = {}
    for i, d in enumerate(docs):
        least[root(i)] = min(least.get(root(i), d.doc_id), d.doc_id)
    return [d for i, d in enumerate(docs) if least[root(i)] == d.doc_id]


def test_pipeline_equals_plain_loops(spark, tmp_path):
    docs = [Doc(*r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*Doc._fields).collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [d for d in docs if good(d.text)]
    plant = [Doc(10_000 + i, f"{d.text}\nshared footer line of many sites", "en", f"site{i}", 0) for i, d in enumerate(clean[:14])]
    plant += [d._replace(doc_id=20_000 + i) for i, d in enumerate(clean[20:26])]  # copies
    plant += [d._replace(doc_id=25_000 + i, text=d.text.replace("e", "x", 2)) for i, d in enumerate(clean[26:29])]  # near copies
    plant += [d._replace(doc_id=30_000 + i, text=f"{d.text} {items[i][1]} {d.text}") for i, d in enumerate(clean[30:33])]  # leaks
    docs += plant
    source = str(tmp_path)
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{source}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{source}/benchmark.parquet")

    want = [[d for d in docs if good(d.text)]]
    want.append(without_spread(want[-1]))
    want.append(first_of_groups(want[-1]))
    leaks = {d for d, *_ in pairs([(d.doc_id, d.text) for d in want[-1]], items)}
    want.append([d for d in want[-1] if d.doc_id not in leaks])
    assert [len(w) for w in want] == sorted((len(w) for w in want), reverse=True) and len(want[1]) > len(want[2]) > len(want[3])

    now = spark.read.parquet(f"{source}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, now, source).write.parquet(f"{source}/stage{k}")
        now = spark.read.parquet(f"{source}/stage{k}")
        assert now.columns == list(Doc._fields)
        assert sorted(map(tuple, now.collect())) == sorted(map(tuple, want[k])), name
    rows = corpus_pipeline.STAGES[-1][1](spark, now, source).collect()
    check_packing(rows, want[-1], Limits())
    whole = corpus_pipeline.run(spark, source).collect()
    place = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(place, whole)) == sorted(map(place, rows))


def test_pipeline_over_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_odd_rows_in_their_columns(spark, odd_docs, tmp_path):
    spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd_docs, str(tmp_path))
        assert out.columns == odd_docs.columns and out.count() <= odd_docs.count(), name
