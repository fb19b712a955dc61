"""A batch of a stream holds no records as they are: what is read again is packed, and only the last event of an id is typed."""

import json

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from procspark.plans.ingest_queries import ingest_ts
from procspark.sources import topics
from procspark.streaming import ingest

OLD = "0850-03-04"  # before the calendars part


def record(i, value, day="2024-01-02"):
    return "CPPP", json.dumps({"tender_id": i, "value": value, "vendor": "a", "department": "b", "date": day})


def test_ingest_caches_nothing(spark, monkeypatch, tmp_path):
    cached, write = [], ingest.write_batch
    monkeypatch.setattr(ingest, "write_batch", lambda *a, **k: cached.append(spark.sparkContext._jsc.getPersistentRDDs().size()) or write(*a, **k))
    spark.catalog.clearCache()
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    for n, rows in enumerate([[record("A", "1"), record("B", "2", OLD)], [record("A", "1"), record("B", "3", OLD)]]):
        ingest.ingest_batch(spark, spark.createDataFrame(rows, "feed string, raw string"), n, str(tmp_path), ingest_ts())
    assert cached == [before] * 4
    events = spark.read.parquet(f"{tmp_path}/raw_transactions").collect()
    assert sorted((r.batch_id, r.key) for r in events) == [(0, "A"), (0, "B"), (1, "B")]
    assert {json.loads(r.value)["timestamp"][:10] for r in events if r.key == "B"} == {OLD}
    for part in tmp_path.glob("raw_transactions/*/*.parquet"):
        assert pq.ParquetFile(part).metadata.row_group(0).column(0).compression == "ZSTD"


def test_only_last_events_are_typed(spark, monkeypatch, tmp_path):
    typed, own = [], ingest.to_transactions
    monkeypatch.setattr(ingest, "to_transactions", lambda df, *a: typed.append(df.count()) or own(df, *a))
    rows = [(f"k{i}", json.dumps({"transaction_id": f" t{i % 5} ", "vendor": f"Foo {i} Ltd", "amount": i}), i) for i in range(50)]
    rows += [("b", "{", 50), ("n", json.dumps({"vendor": "x"}), 51)]
    ingest.upsert_batch(spark.createDataFrame(rows, "key string, value string, offset bigint"), 0, str(tmp_path), ingest_ts())
    assert typed == [5]
    assert sorted((r.external_id, float(r.amount)) for r in ingest.transactions(spark, str(tmp_path)).collect()) == [(f"t{i}", 45.0 + i) for i in range(5)]
    assert sorted(r.name for r in ingest.vendors(spark, str(tmp_path)).collect()) == [f"Foo {i} Ltd" for i in range(45, 50)]
    assert spark.read.parquet(f"{tmp_path}/dead_letters").count() == 2


def test_columns_beside_an_event(spark):
    df = spark.createDataFrame([("t", 3)], "transaction_id string, ln int")
    r = topics.to_event(df, "raw_transactions", ["ln"]).first()
    assert r.ln == 3 and json.loads(r.value)["ln"] == 3 and r.key == "t"
    assert topics.to_event(df.withColumn("x", F.lit(1)), "raw_transactions").columns == ["key", "value"]


def test_names_keep_their_classes(spark):
    """Every character of the first planes falls into the same class as before: kept, white space, or a space."""
    import re

    from procspark.functions import names

    texts = [f"a{chr(i)}b" for i in [*range(1, 0x300), 0x1680, 0x2003, 0x3000, 0x1F600] if not 0xD800 <= i < 0xE000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plan = df.select(names.normalize_vendor_name(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "[^a-z0-9\\s]" not in plan and "RLIKE" not in plan
    for t, got, kept in df.select("t", names.normalize_vendor_name(F.col("t")), F.lower(names.nfkd(F.col("t")))).collect():
        assert got == " ".join(re.sub(r"[^a-z0-9\s]", " ", kept, flags=re.ASCII).split()), hex(ord(t[1]))


def test_dead_letters_are_found_by_their_id(spark):
    rows = [("a", json.dumps({"transaction_id": "t", "vendor": "v"})), ("b", "{"), ("c", json.dumps({"transaction_id": " "})),
            ("d", '{"transaction_id": "t", "vendor": '), ("e", '{"transaction_id": 5}'), ("f", None), ("g", '[{"transaction_id": "t"}]')]
    good, dead = topics.parse_events(spark.createDataFrame(rows, "key string, value string"))
    assert good.count() + dead.count() == len(rows)
    assert {"b", "c", "d", "f"} <= {r.key for r in dead.collect()}
    assert dead.columns == ["key", "value"]
    assert "vendor" not in dead._jdf.queryExecution().optimizedPlan().toString()
