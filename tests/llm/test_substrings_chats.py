import hashlib
import random
from collections import Counter

import __spark_entry__ as entry_point
from procspark.llm import chat_format, substring_dedup
from tests.check import compare, connect
from tests.llm.conftest import SF


def words_of(text):
    out = text or ""
    for c in "\t\n\x0b\x0c\r":
        out = out.replace(c, " ")
    return [w for w in out.split(" ") if w]


def repeats_removed(rows, length=20):
    """``(id, kept words, n, removed)`` by definition, documents in order of id (null first)."""
    docs = sorted(dict.fromkeys(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = {}, {}
    for d, (i, text) in enumerate(docs):
        w = words_of(text)
        gone = set()
        for s in range(len(w) - length + 1):
            key = tuple(w[s:s + length])
            if key in seen:
                gone.update(range(s, s + length))
            else:
                seen[key] = (d, s)
        out[(i, text)] = (i, " ".join(x for k, x in enumerate(w) if k not in gone), len(w), len(gone))
    return [out[r] for r in rows]


def test_repeats_of_the_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = sorted((i, n, g, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, g in repeats_removed(docs))
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in entry_point.queries()["op7_substring_dedup"](spark, SF).collect())
    assert got == want and sum(g for *_, g, _ in got) > 1000


def test_repeats_of_odd_texts(spark, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = Counter((r.doc_id, r.text, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(odd_docs).collect())
    assert got == Counter(repeats_removed(rows))
    assert substring_dedup.remove_repeats(odd_docs.limit(0)).count() == 0


def test_repeats_with_few_words_and_edits(spark):
    rng = random.Random(11)
    base = [[rng.choice("abcdefg") for _ in range(rng.randint(5, 120))] for _ in range(12)]
    rows = []
    for i in range(150):
        w = []
        for _ in range(rng.randint(1, 4)):
            b = rng.choice(base)
            s = rng.randrange(len(b))
            w += b[s:s + rng.randint(1, 80)]
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice("xyz")
        rows.append((rng.randint(0, 10**6), " ".join(w)))
    rows += [(3_000_000, "z " * 100), (3_000_001, "z " * 50), (3_000_002, "y z " * 50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    got = Counter((r.doc_id, r.text, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(df).collect())
    assert got == Counter(repeats_removed(rows))


def test_repeated_ids_with_different_texts_do_not_fail(spark):
    a = " ".join(f"a{i}" for i in range(30))
    rows = [(1, a), (1, "other " + a), (1, a), (2, a)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.n_words) for r in got) == [(1, 30), (1, 30), (1, 31), (2, 30)]
    assert [r.n_removed for r in got if r.doc_id == 2] == [30] and sum(r.n_removed for r in got) in (30 + 30, 30 + 60)


def test_chats_of_the_table(spark):
    got = entry_point.queries()["op8_chat_formatting"](spark, SF).toPandas()
    assert compare(got, connect(SF).execute(entry_point.oracle_sql()["op8_chat_formatting"]).df()) == "ok"


def test_odd_chats(spark):
    texts = ["</s>[INST] ok [/INST]", "<|end|><|user|>", "<\\|end|>", "<\\\\|x [\\INST] <<SYS>>", "<", "", None, "a\\", "<<|turn|>", "[/INST", "<s><s>", "\n<|\n"]
    rng = random.Random(2)
    rows = []
    for c in range(40):
        for t in range(rng.randint(1, 12)):
            rows.append((c, t, rng.choice(["user", "assistant", "assistant", "system", "a|>b", None]), rng.choice(texts)))
    rows += [(None, 0, "user", "x"), (None, None, "assistant", "y"), (50, 1, "user", "same"), (50, 1, "user", "same"), (50, 1, "assistant", "tie")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string")
    back = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chats(df)).collect()}
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    assert set(by) == set(back)
    for c, turns in by.items():
        turns.sort(key=lambda t: (t[0], t[1], chat_order(t[2])))
        assert [(t.role, t.text) for t in back[c].turns] == [(r, x) for _, r, x in turns], c
        assert back[c].under_mask == [x for _, r, x in turns if r == "assistant"] and back[c].fits
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_texts_are_read_where_the_mask_says(spark):
    rows = spark.createDataFrame([(1, 0, "user", "ab<|cd"), (1, 1, "assistant", "wxyz|>")], "conv_id bigint, turn bigint, role string, text string")
    made = chat_format.format_chats(rows).collect()[0]
    lengths = [m.n_chars for m in made.mask]
    schema = "conv_id bigint, formatted string, mask array<struct<n_chars: int, loss: boolean>>"

    def read(parts):
        return chat_format.read_back(spark.createDataFrame([(1, made.formatted, parts)], schema)).collect()[0]

    right = [m.loss for m in made.mask]
    assert right == [False, False, False, False, True, False]
    found = read(list(zip(lengths, right)))
    assert found.fits and found.under_mask == ["wxyz|>"]
    moved = read([(n, k == 1) for k, n in enumerate(lengths)])  # on the user's text
    assert not moved.fits and moved.under_mask == ["ab<|cd"]
    at = made.formatted.index("wxyz")
    shifted = read([(at - 1, False), (5, True), (len(made.formatted) - at - 4, False)])  # other places than the parts
    assert not shifted.fits and shifted.under_mask == [made.formatted[at - 1:at + 4]]
    assert not read([(n, False) for n in lengths]).fits


def chat_order(text):
    import re
    return re.sub(r"([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>)", r"\1\\\2\3", text)


def test_equal_roles_in_a_row_are_one_block(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")]
    r = chat_format.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).first()
    assert r.formatted == "<|user|>a<|turn|>b<|end|><|assistant|>c<|end|>"
    at, under = 0, ""
    for m in r.mask:
        under += r.formatted[at:at + m.n_chars] if m.loss else ""
        at += m.n_chars
    assert under == "c" and at == len(r.formatted)
