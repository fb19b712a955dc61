"""Event topics: envelopes, readers and writers. Kafka in production, files in tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from procspark.sources.payloads import once

# Topic -> (event type, key column).
TOPICS = {
    "raw_transactions": ("TRANSACTION_CREATED", "transaction_id"),
    "anomalies": ("ANOMALY_DETECTED", "case_id"),
    "triage": ("TRIAGE_COMPLETE", "case_id"),
    "deep_audit": ("DEEP_AUDIT_REQUESTED", "case_id"),
}
RAW_EVENT = ("event_type string, transaction_id string, buyer string, vendor string, amount string, currency string,"
             " timestamp string, source string, description string, category string, country string, ingested_at string")


def to_event(df: DataFrame, topic: str, beside: list[str] = ()) -> DataFrame:
    """Key and JSON value of each row; the key keeps all events of one id in one partition. ``beside``: columns that also go with the event."""
    event_type, key = TOPICS[topic]
    rest = [c for c in df.columns if c != key]
    return df.select(F.col(key).cast("string").alias("key"),
                     F.to_json(F.struct(F.lit(event_type).alias("event_type"), key, *rest)).alias("value"), *beside)


def parse_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw transaction events, and apart from them the messages without a usable id."""
    text = F.col("value").cast("string")
    ok = F.coalesce(F.trim("e.transaction_id") != "", F.lit(False)) & F.try_parse_json(text).isNotNull()
    keep = [c for c in ("offset", "ts_in") if c in events.columns]
    # the messages apart are found by their id alone, so a pass over them reads no other field
    return (once(events, "e", F.from_json(text, RAW_EVENT)).filter(ok).select("e.*", *keep),
            once(events, "e", F.from_json(text, "transaction_id string")).filter(~ok).drop("e"))


def read_topic(spark: SparkSession, topic: str, servers: str | None = None, folder: str | None = None,
               **options: str) -> DataFrame:
    """A stream of ``key, value``; from Kafka, or from a folder of JSON files of that shape."""
    if servers:
        reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
        return reader.options(**options).load()
    return spark.readStream.schema("key string, value string, offset bigint").options(**options).json(folder)


def write_topic(df: DataFrame, topic: str, checkpoint: str, servers: str | None = None,
                folder: str | None = None) -> DataStreamWriter:
    out = to_event(df, topic).writeStream.option("checkpointLocation", checkpoint)
    if servers:
        return out.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
    return out.format("json").option("path", folder)
