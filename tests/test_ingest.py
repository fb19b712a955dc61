import gzip
import json
import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from procspark.functions import names, values
from procspark.operators import quality, upserts
from procspark.sources import awards, payloads


def raw(spark, *records):
    return spark.createDataFrame([(json.dumps(r),) for r in records], "raw string")


def now():
    return F.lit("2030-01-01").cast("timestamp")


def names_of(spark, fn, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [r[0] for r in df.select(fn(F.col("t"))).collect()]


def test_vendor_names(spark):
    got = names_of(spark, names.normalize_vendor_name, "ABC Ltd", "ABC Pvt Ltd", "A.B.C Limited", "Société Générale, Inc.", "", None, "Corp.", "Ｆｕｌｌ width Co")
    assert got == ["abc", "abc", "a b c", "socie te ge ne rale", "unknown_vendor", "unknown_vendor", "unknown_vendor", "full width"]
    assert names_of(spark, lambda c: names.normalize_vendor_name(c, strip_marks=True), "Société") == ["societe"]
    assert names_of(spark, names.normalize_vendor_name_loose, "IBM Corp", " Vendor \t Name ") == ["ibm corp", "vendor name"]
    assert names_of(spark, names.normalize_buyer_name, "  A \n b ", "", None) == ["A b", "UNKNOWN_BUYER", "UNKNOWN_BUYER"]


def test_vendor_id_is_uuid5(spark):
    texts = ["abc", "unknown_vendor", "a b c", "x" * 200]
    got = names_of(spark, names.canonical_vendor_id, *texts)
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_DNS, f"vendor:{t}")) for t in texts]
    assert names_of(spark, names.canonical_vendor_id, None) == [None]


def test_award_records(spark):
    full = {"Award ID": "CONT_AWD_123", "Recipient Name": "Acme Defense Systems", "Recipient DUNS Number": "ABC123DEF456", "Award Amount": 500000,
            "Last Modified Date": "2024-03-01", "Fiscal Year": 2024, "Award Type": "A"}
    df = awards.parse_award_record(raw(spark, full, {"Award ID": "MINIMAL-001"}, {"Award ID": "B", "Award Amount": "not a number"}), now())
    a, b, c = df.collect()
    assert (a.external_id, a.vendor_name, a.vendor_uei, a.fiscal_year, a.amount) == ("CONT_AWD_123", "Acme Defense Systems", "ABC123DEF456", 2024, 500000.0)
    assert (b.external_id, b.vendor_name, b.vendor_uei, b.category, b.description) == ("MINIMAL-001", "UNKNOWN VENDOR", None, None, None)
    assert c.amount == 0.0


def test_ocds_and_tender_to_dollars(spark):
    release = {"ocid": "o1", "contracts": [{"value": {"amount": None}}], "awards": [{"value": {"amount": 10, "currency": "GBP"}, "suppliers": [{"id": "s1"}]}],
               "parties": [{"id": "s1", "name": "Foo Ltd"}], "date": "2026-01-01"}
    rows = payloads.normalize_sources({"OCDS": raw(spark, release), "CPPP": raw(spark, {"tender_id": "T1", "value": "100", "department": "D"})}, now())
    o, t = rows.orderBy("source").collect()[::-1]
    assert (float(o.amount), o.currency, o.vendor) == (10, "GBP", "Foo Ltd")
    assert (t.currency, t.vendor, t.buyer) == ("INR", "UNKNOWN_VENDOR", "D")
    clean = {r.source: r for r in quality.clean_records(rows, ["transaction_id"]).collect()}
    assert (f"{clean['OCDS'].amount:.2f}", clean["OCDS"].currency, clean["OCDS"].vendor) == ("12.80", "USD", "foo")
    assert (f"{clean['CPPP'].amount:.2f}", clean["CPPP"].vendor) == ("1.20", "unknown vendor")


def test_half_even_cents(spark):
    df = spark.createDataFrame([("10.5", "INR"), ("0.125", "USD"), ("7", "JPY"), ("10.005", "JPY"), ("3.125", "KWD"), ("12345678901234567890.5", "XXX")], "a string, c string")
    usd = values.usd_amount(F.col("a").cast("decimal(38,6)"), F.col("c"))
    assert [r[0] for r in df.select(values.amount_text(usd)).collect()] == ["0.13", "0.12", "7.00", "10.005", "3.125", "12345678901234567890.50"]


def test_supplier_fallbacks(spark):
    base = {"awards": [{"suppliers": [{"id": "a"}, {"id": "b"}]}], "parties": [
        {"id": "b", "name": "By id"}, {"id": "z", "name": "By role", "roles": ["SUPPLIER"]}]}
    named = {"awards": [{"suppliers": None}, None, {"suppliers": [{"id": "a"}, {"name": "Named"}]}], "parties": base["parties"]}
    rows = payloads.canonicalize_ocds(raw(
        spark, {"ocid": "1", **base}, {"ocid": "2", **named}, {"ocid": "3", "parties": base["parties"]}, {"id": "4"},
        {"releases": [{"x": 1}, {"ocid": "5", **named}]}, {"records": [{"compiledRelease": {"ocid": "6"}}]}, {"tag": "no id"}), now())
    assert {r.transaction_id: r.vendor for r in rows.collect()} == {
        "1": "By id", "2": "Named", "3": "By role", "4": "UNKNOWN_VENDOR", "5": "Named", "6": "UNKNOWN_VENDOR"}


def test_dedup_keeps_the_first(spark):
    rows = [(i, t, "v", "b", "1.00", datetime(2026, 1, 1), "USA") for i, t in enumerate(["A", " a ", "", ""])]
    df = spark.createDataFrame(rows, "n int, transaction_id string, vendor string, buyer string, amount string, timestamp timestamp, source string")
    assert sorted(r.n for r in quality.dedup_records(df, ["n"]).collect()) == [0, 2]


def test_change_detection(spark):
    schema = "transaction_id string, vendor string, amount int, source string"
    rows = [(str(i), "v", i, "USA") for i in range(5)]
    state = spark.createDataFrame([], "change_key string, digest string")
    first, state = quality.change_detect(spark.createDataFrame(rows, schema), state)
    assert first.count() == 5
    again, state = quality.change_detect(spark.createDataFrame(rows, schema), state)
    assert again.count() == 0
    changed, state = quality.change_detect(spark.createDataFrame([("0", "v", 99, "USA"), *rows[1:]], schema), state)
    assert changed.count() == 1 and state.count() == 5


def test_tender_page(spark):
    page = ("<table><tr><th>h</th></tr><tr><td>Tender Title</td><td>Reference No</td><td>Closing</td><td>Opening</td></tr>"
            "<tr><td>Road works</td><td>REF/12</td><td>01-02-2026</td><td>03-02-2026</td></tr></table>")
    rows = payloads.html_tender_rows(spark.createDataFrame([(1, page), (2, None)], "id int, html string")).collect()
    assert [(r.tender_id, r.published_date, r.description) for r in rows] == [("REF/12", "01-02-2026", "Road works")]


def test_payload_shapes(spark):
    df = spark.createDataFrame([(1, '[{"a":1}, 2, "x"]'), (2, '{"data": "x", "items": [{"a":2}]}'), (3, '{"records": [], "data": [{"a":3}]}'), (4, "{}"), (5, "oops")],
                               "id int, payload string")
    assert [(r.id, json.loads(r.raw)) for r in payloads.extract_records(df).orderBy("id").collect()] == [(1, {"a": 1}), (2, {"a": 2})]


def test_jsonl_plain_and_gzip(spark, tmp_path):
    lines = b'{"a":1}\n\n[1]\n{"a":\n  {"b":"\xff"}\n7\n'
    (tmp_path / "x.jsonl").write_bytes(lines)
    (tmp_path / "y.jsonl.gz").write_bytes(gzip.compress(lines))
    rows = [r.raw for r in payloads.read_jsonl(spark, str(tmp_path)).collect()]
    assert len(rows) == 4 and rows.count('{"a":1}') == 2


def test_catalog_urls_keep_first_position(spark):
    body = {"result": {"results": [{"resources": [{"url": "u2", "format": "JSON"}, {"url": "u1.JSON", "format": "csv"}, {"url": "u3", "format": "csv"}]},
                                   {"resources": [{"url": " u2 ", "format": "json"}]}, {}]}}
    df = spark.createDataFrame([(1, json.dumps(body))], "page_id int, payload string")
    assert [r.url for r in payloads.resource_urls(df).orderBy("first_at").collect()] == ["u2", "u1.JSON"]


def test_custom_source(spark):
    payloads.register_source("X", lambda df, ts: payloads.canonicalize_usa(df, ts).withColumn("source", F.lit("X")))
    try:
        rows = payloads.normalize_sources({"X": raw(spark, {"award_id": "1"})}, now()).collect()
        assert rows[0].source == "X" and rows[0].vendor == "UNKNOWN_VENDOR"
    finally:
        payloads.SOURCES.pop("X")


def test_dimension_families(spark):
    df = spark.createDataFrame([("US Army", "541511"), ("Savannah", "Facility upkeep"), ("VA", "it desk"), ("", None)], "a string, c string")
    got = df.select(values.agency_family(F.col("a")), values.category_family(F.col("c"))).collect()
    assert [tuple(r) for r in got] == [("DEFENSE", "PROFESSIONAL_SERVICES"), ("OTHER_FEDERAL", "CONSTRUCTION"), ("VETERANS", "INFORMATION_TECHNOLOGY"), ("UNKNOWN", "UNKNOWN")]
    old = df.select(values.agency_family(F.col("a"), True), values.category_family(F.col("c"), True)).collect()
    assert [tuple(r) for r in old] == [("DEFENSE", "OTHER"), ("VETERANS", "INFORMATION_TECHNOLOGY"), ("VETERANS", "INFORMATION_TECHNOLOGY"), ("UNKNOWN", "UNKNOWN")]


def sequential_upsert(vendors, records):
    """The rule as a loop: number, then name, then a new vendor."""
    table = [dict(v) for v in vendors]
    placed = []
    for seq, name, uei, country in records:
        loose = " ".join(name.lower().split())
        hit = next((v for v in table if uei and v["duns"] == uei), None) or next((v for v in table if v["loose"] == loose), None)
        if hit is None:
            hit = {"loose": loose, "duns": uei, "country": country}
            table.append(hit)
        elif country and not hit["country"]:
            hit["country"] = country
        placed.append((seq, hit["loose"]))
    return sorted((v["loose"], v["duns"], v["country"]) for v in table), placed


@pytest.mark.parametrize("seed", range(4))
def test_upsert_vendor_follows_the_order(spark, seed):
    import random
    rnd = random.Random(seed)
    vendors = [{"loose": "old one", "duns": "U1", "country": None}, {"loose": "old two", "duns": None, "country": "CAN"}]
    pool = ["old one", "old two", "na", "nb", "nc", "nd"]
    records = [(i, rnd.choice(pool), rnd.choice([None, None, "U1", "U2", "U3"]), rnd.choice([None, "USA"])) for i in range(25)]
    stored = spark.createDataFrame([(v["loose"], v["loose"], v["loose"], v["duns"], v["country"]) for v in vendors],
                                   "vendor_id string, name string, normalized_name string, duns_number string, country string")
    table, placed = upserts.upsert_vendor(stored, spark.createDataFrame(records, "n int, vendor_name string, vendor_uei string, vendor_country string"), ["n"])
    want_table, want_placed = sequential_upsert(vendors, records)
    by_id = {r.vendor_id: r.normalized_name for r in table.collect()}
    assert sorted((r.normalized_name, r.duns_number, r.country) for r in table.collect()) == want_table
    assert sorted((r.n, by_id[r.vendor_id]) for r in placed.collect()) == want_placed
