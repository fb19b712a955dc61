import hashlib
import re
import zlib
from collections import Counter

import numpy as np

import __spark_entry__ as entry_point
from procspark.llm import html_extract, quality_bands, secret_scan
from tests.llm.conftest import SF

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h2>Site name, since 1999.</h2></header><nav><ul><li><a href="/">Home</a><li><a href="/b">News, all of it</a></ul></nav>
<div class="cookie-notice">We use cookies, many of them, to do a lot of things, all day long.</div><!-- no <p>text</p> -->
%s
<aside><p>Read this, too: a long teaser about something else, really.</p></aside>
<div id="comments"><p>First, I liked it. Second, I did not. Third, whatever.</p></div>
<form><p>Your name, please.</p></form><footer>&copy; 2020, all rights, reserved.</footer></body></html>"""
BODY = "<h1>A &amp; B</h1><p><b>One  sentence,\n here.<br><p>Another&nbsp;one, with <i>marks</i>; &#233;t&eacute;.<p>End.</p>"
WANT = "A & B\nOne sentence, here.\nAnother one, with marks; été.\nEnd."


def test_article_without_the_rest():
    assert html_extract.main_text(PAGE % f"<article>{BODY}</article>") == WANT
    assert html_extract.main_text(PAGE % f'<div class="wrap"><div class="post">{BODY}</div></div>') == WANT
    inner = f'<article>{BODY}<div class="ad">Buy it, now, here, today.</div></article>'
    assert html_extract.main_text(PAGE % inner) == WANT


def test_odd_pages(spark):
    rows = [(1, "a", None), (2, "b", ""), (3, None, "plain text, no tags"), (4, "d", "<p>" * 3000 + "deep. text, here"), (5, "e", "<div class='x><p>broken, but there."),
            (6, "f", "a < b and <script>x"), (7, "g", "<p>twice, the same.</p>"), (7, "g", "<p>twice, the same.</p>")]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id bigint, url string, html string, text string, n_chars int")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in html_extract.extract(df).collect()), key=lambda r: r[0])
    assert [r[2] for r in got] == ["", "", "plain text, no tags", "deep. text, here", got[4][2], "a < b and", "twice, the same.", "twice, the same."]
    assert all(len(r[2]) == r[3] for r in got)
    assert html_extract.extract(df.limit(0)).count() == 0


def test_pages_of_the_table(spark):
    got = {r.page_id: r.text for r in entry_point.queries()["op1_html_extraction"](spark, SF).collect()}
    from html import unescape
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:  # here the article stands in one element of known blocks
        inner = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert got[p.page_id] == "\n".join(b for b in blocks if b)


def spans_by_definition(text):
    base = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
            ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile(r"[0-9a-f]+"), 0, 32)]
    out = []
    for k, (kind, regex, group, least) in enumerate(base):
        out += [(m.start(), k, kind, m.end()) for m in regex.finditer(text) if len(m[group]) >= least]
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out)]


def test_secrets_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in entry_point.queries()["op2_secret_scans"](spark, SF).collect()}
    hits = 0
    for d in docs:
        want = spans_by_definition(d.text)
        hits += len(want)
        r = got[d.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex"))
        assert set(want) <= set(r.spans.split(","))
    assert hits > 10 and len(got) == len(docs)


def test_odd_secrets(spark):
    texts = [None, "", "é Token = 'abcdefgh' ſecret=abcdefgh", "to" + "ken=12345678", "password=token=abc", "api_key: AKIA" + "A1" * 8, "f" * 31, "a" * 32 + "g" + "0" * 40,
             "apikey=short token=password=abcdefgh1", "tok", "en=12345678", "x" * 100000 + " secret:" + "z" * 9, "ghp_" + "a" * 40 + " gh" + "p_short"]
    df = spark.createDataFrame([(i, t, "q") for i, t in enumerate([*texts, texts[2]])], "doc_id bigint, text string, spans string")
    got = {r.doc_id: [f"{s.kind}:{s.start}:{s.end}" for s in r.spans] for r in secret_scan.scan(df).collect()}
    base = {"assign", "access", "hex"}
    for i, t in enumerate([*texts, texts[2]]):
        assert [s for s in got[i] if s.split(":")[0] in base] == spans_by_definition(t or ""), t
    assert any(s.startswith("github") for s in got[12])
    assert secret_scan.scan(df.limit(0)).count() == 0


def test_trigram_queries():
    assert secret_scan.trigram_query("[0-9a-f]+") == ("all",)
    assert secret_scan.trigrams_in(secret_scan.trigram_query(r"AKIA[A-Z0-9]+")) == {b"aki", b"kia"}
    assert secret_scan.trigram_query("(abc|ab?)x") == ("all",) or secret_scan.trigram_query("(abc|ab?)x")[0] == "or"
    q = secret_scan.trigram_query(r"(foo|ba_?r)[:=]?\d+")
    assert q[0] == "or" and {b"foo", b"bar", b"ba_"} <= secret_scan.trigrams_in(q)


def test_index_rows_hold_exactly_their_trigrams(spark, odd_docs):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a token", "TOKEN", "to", "ken", None, "akia", "xakib"])], "doc_id bigint, text string")
    got = {}
    for r in secret_scan.trigram_index(docs).collect():
        got.setdefault(r.trigram, set()).update(r.ids)
    assert got["tok"] == {0, 1} and got["ken"] == {0, 1, 3} and got["aki"] == {5, 6} and got["kia"] == {5}


def measures(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = Counter(zip(words, words[1:], words[2:]))
    again = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(again), n < 50 or 100 * len(again) > 50 * n


def test_quality_of_the_table_and_odd_texts(spark, odd_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (docs, odd_docs):
        got = Counter(tuple(r)[:7] for r in quality_bands.measure(df).collect())
        assert got == Counter((d.doc_id, *measures(d.text)) for d in df.collect())
    assert quality_bands.measure(docs.limit(0)).count() == 0


def test_clean_labelled_texts_are_kept_and_noise_is_not(spark):
    sf = SF.replace("0.01", "0.1")
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1")
    got = quality_bands.measure(spark.read.parquet(f"{sf}/documents.parquet")).join(labels, "doc_id")
    assert got.filter("not base_failed and not kept").count() == 0
    rng = np.random.default_rng(zlib.crc32(b"noise"))
    packed = " ".join("".join(chr(c) for c in rng.integers(33, 127, 70)) for _ in range(80))
    again = " ".join("samesamesame" + "ab"[b % 2] * (b // 2 + 1) for b in range(120))
    plain = docs_text(spark)
    rows = [(1, packed), (2, again), (3, plain)]
    out = {r.doc_id: r for r in quality_bands.measure(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert not out[1].base_failed and not out[1].kept
    assert not out[2].base_failed and not out[2].kept
    assert out[3].kept
    assert quality_bands.keep_good(spark.createDataFrame(rows, "doc_id bigint, text string")).columns == ["doc_id", "text"]


def docs_text(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id = 0").first().text
