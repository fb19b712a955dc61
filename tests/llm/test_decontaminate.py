import __spark_entry__ as entry_point
from procspark.llm import decontaminate
from tests.check import compare, connect
from tests.llm.conftest import SF


def shingles(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    w = [x for x in lowered.split(" ") if x]
    return {" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def pairs(docs, items):
    by = {}
    for i, t in items:
        if i is not None:
            by.setdefault(i, set()).update(shingles(t))
    out = set()
    for d, t in docs:
        s = shingles(t)
        out |= {(d, i, len(s & x), len(x)) for i, x in by.items() if x and 5 * len(s & x) >= 4 * len(x)}
    return out


def test_leaks_of_the_table(spark):
    got = entry_point.queries()["op10_benchmark_decontamination"](spark, SF).toPandas()
    assert len(got) and compare(got, connect(SF).execute(entry_point.oracle_sql()["op10_benchmark_decontamination"]).df()) == "ok"


def test_odd_documents_and_items(spark, odd_docs):
    passage = " ".join(f"word{i}" for i in range(60))
    items = [(1, passage), (1, passage), (2, None), (3, ""), (4, "the QUICK brown fox"), (5, " ".join(f"word{i}" for i in range(30, 45)) + " other end here"), (None, passage),
             (6, " ".join(f"word{i}" for i in range(10, 30)) + " x"), (7, "a a a a a a a"), (8, "same words for all of us"), (9, "same words for all of us"),
             (10, " ".join(f"long{i % 700}" for i in range(900, 1500)))]
    table = spark.createDataFrame([(*r, 0) for r in items], "item_id bigint, text string, n int")
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = decontaminate.contaminated(odd_docs, table).collect()
    want = pairs(docs, items)
    assert sorted(((r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in got), key=str) == sorted(want, key=str)
    assert {i for _, i, *_ in want} >= {1, 4, 6, 7, 10}
    bad = {d for d, *_ in want}
    kept = decontaminate.clean(odd_docs, table)
    assert kept.columns == odd_docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted((d for d in docs if d[0] not in bad), key=str)
    assert decontaminate.contaminated(odd_docs.limit(0), table).count() == 0
    assert decontaminate.contaminated(odd_docs, table.limit(0)).count() == 0 and decontaminate.clean(odd_docs, table.limit(0)).count() == odd_docs.count()


def test_every_share_from_the_threshold_on_is_found(spark):
    rows, items = [], []
    for n in range(5, 80):
        words = [f"i{n}w{k}" for k in range(n)]
        items.append((n, " ".join(words)))
        for cutoff in range(0, n, 3):
            rows.append((n * 100 + cutoff, "before it " + " ".join(words[cutoff:]) + " behind it " * 40))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == pairs(rows, items)
