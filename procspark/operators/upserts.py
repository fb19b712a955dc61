"""Keyed writes as snapshot transforms. A table format with MERGE can replace the bodies, not the callers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procspark.functions.names import canonical_vendor_id, normalize_vendor_name, normalize_vendor_name_loose
from procspark.session import cut
from procspark.streaming.buckets import BucketState


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key; a map-side combine keeps hot keys small. Rows without a key are not each other's versions: all stay."""
    alone = F.when(F.col(key).isNull(), F.monotonically_increasing_id()).alias("alone*")
    return df.groupBy(key, alone).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), F.struct(*order)).alias("r")
                                      ).select(key, "r.*").select(*df.columns)


def upsert_latest(snapshot: DataFrame, batch: DataFrame, key: str, order: list[str],
                  set_to: dict[str, Column] | None = None) -> DataFrame:
    """Replace or add the batch's last row per key; ``set_to`` overrides columns of touched rows.

    Columns the batch does not carry keep their stored value. Rows without a key are added. This is the form for a snapshot that is read and written
    whole; ``merge_buckets`` rewrites only what a batch touches.
    """
    new = latest(batch, key, order).drop(*[c for c in order if c not in snapshot.columns])
    for name, value in (set_to or {}).items():
        new = new.withColumn(name, value)
    new = new.withColumn("touched", F.lit(True))
    renamed = new.select(F.col(key), F.struct(*[c for c in new.columns if c != key]).alias("b"))
    joined = snapshot.withColumn("stored", F.lit(True)).join(renamed, key, "full")
    hit = F.col("b.touched").isNotNull()
    cols = [F.col(key)]
    for c in snapshot.columns:
        if c == key:
            continue
        if c in new.columns:
            cols.append(F.when(hit, F.col(f"b.{c}")).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return joined.select(*cols)


def merge_buckets(store: BucketState, batch: DataFrame, batch_id: int, order: list[str], keep_stored: bool = False) -> list[int]:
    """Put the batch's last row per key (its first, with ``keep_stored``, for keys not stored yet) into a bucketed table; returns the buckets rewritten.

    Copy on write: the buckets of the batch's keys are read, merged and written under the batch's number, all others stay the files they are and
    are taken over by name. A batch that is run again gives the same table. Rows without a key are left out: they have no bucket.
    """
    key = store.key
    keyed = batch.filter(F.col(key).isNotNull())
    pick = F.min_by if keep_stored else F.max_by
    new = keyed.groupBy(key).agg(pick(F.struct(*[c for c in batch.columns if c != key]), F.struct(*order)).alias("r")).select(key, "r.*")
    touched = store.touched(keyed, before=batch_id)
    stored = store.read(touched, before=batch_id)
    new = new.select(*stored.columns)
    if keep_stored:
        merged = stored.unionByName(new.join(stored.select(key), key, "left_anti"))
    else:
        merged = stored.join(new.select(key), key, "left_anti").unionByName(new)
    store.write(merged, touched, batch_id)
    return touched


def insert_if_absent(snapshot: DataFrame, batch: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows to add: positive amount, the first of its key in the batch, key not stored yet."""
    usable = batch.filter(F.col("amount") > 0)
    keyed = usable.filter(F.coalesce(F.col(key) != "", F.lit(False)))
    others = [c for c in batch.columns if c != key]
    first = keyed.groupBy(key).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("r")).select(key, "r.*")
    fresh = first.join(snapshot.select(key), key, "left_anti")
    without_key = usable.filter(~F.coalesce(F.col(key) != "", F.lit(False)))
    return fresh.unionByName(without_key.select(*fresh.columns))


def _first(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    return df.groupBy(key).agg(F.min_by(F.struct(*cols), "seq").alias("r")).select(key, "r.*")


def upsert_vendor(vendors: DataFrame, records: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Match records, in order, by registration number, then by loose name; else create the vendor.

    Returns the vendors after the batch and the records with ``vendor_id``. A record can meet a vendor
    created earlier in the same batch, so the creators are found by a fixed point: the first record of a
    name creates it unless an earlier creator already carries its number. A stored country is only
    filled, never replaced.
    """
    rec = records.withColumn("loose", normalize_vendor_name_loose(F.col("vendor_name"))).withColumn(
        "seq", F.struct(*order))
    by_number = vendors.filter(F.col("duns_number").isNotNull()).groupBy(F.col("duns_number").alias("vendor_uei")).agg(
        F.min("vendor_id").alias("id_by_number"))
    by_name = vendors.groupBy(F.col("normalized_name").alias("loose")).agg(F.min("vendor_id").alias("id_by_name"))
    rec = cut(rec.join(by_number, "vendor_uei", "left").join(by_name, "loose", "left"))
    open_ = rec.filter(F.col("id_by_number").isNull())
    cols = ["vendor_name", "vendor_uei", "vendor_country", "seq"]
    creators, mark = _creators(open_.filter(F.col("id_by_name").isNull()), cols)
    while True:
        owners = creators.filter(F.col("vendor_uei").isNotNull()).withColumnRenamed("loose", "owner").groupBy(
            "vendor_uei").agg(F.min_by("owner", "seq").alias("owner"), F.min("seq").alias("owner_seq"))
        led = open_.join(owners, "vendor_uei", "left").withColumn(
            "owner", F.when(F.col("owner_seq") < F.col("seq"), F.col("owner")))
        again, new_mark = _creators(led.filter(F.col("owner").isNull() & F.col("id_by_name").isNull()), cols)
        if new_mark == mark:
            break
        creators, mark = again, new_mark
    to_id = lambda c: canonical_vendor_id(F.col(c))
    placed = led.withColumn("vendor_id", F.coalesce(to_id("owner"), "id_by_name", to_id("loose")))
    placed = placed.select("vendor_id", "seq", *records.columns).unionByName(
        rec.filter(F.col("id_by_number").isNotNull()).select(
            F.col("id_by_number").alias("vendor_id"), "seq", *records.columns))
    seen = placed.filter(F.coalesce(F.col("vendor_country") != "", F.lit(False))).groupBy("vendor_id").agg(
        F.min_by("vendor_country", "seq").alias("seen"))
    table = vendors.select("vendor_id", "name", "normalized_name", "duns_number", "country").unionByName(
        creators.select(to_id("loose").alias("vendor_id"), F.col("vendor_name").alias("name"),
                        F.col("loose").alias("normalized_name"), F.col("vendor_uei").alias("duns_number"),
                        F.col("vendor_country").alias("country")))
    table = table.join(seen, "vendor_id", "left").withColumn(
        "country", F.coalesce(F.nullif(F.col("country"), F.lit("")), "seen")).drop("seen")
    return table, placed.drop("seq")


def _creators(df: DataFrame, cols: list[str]) -> tuple[DataFrame, tuple]:
    """The first record per name, frozen, and a mark that tells two such sets apart."""
    first = cut(_first(df, "loose", cols))
    row = first.agg(F.count("*"), F.bit_xor(F.xxhash64("loose", "seq"))).first()
    return first, tuple(row)


def vendor_dim_upsert(vendors: DataFrame, records: DataFrame, order: list[str]) -> DataFrame:
    """Stream path: match by clean name only; unseen names become vendors, with the whole text of their first record."""
    named = records.select(normalize_vendor_name(F.col("vendor")).alias("normalized_name"),
                           F.trim("vendor").alias("name"),
                           F.nullif(F.trim("country"), F.lit("")).alias("country"), *order)
    first = named.groupBy("normalized_name").agg(F.min_by(F.struct("name", "country"), F.struct(*order)).alias("r"))
    fresh = first.join(vendors.select("normalized_name"), "normalized_name", "left_anti").select(
        canonical_vendor_id(F.col("normalized_name")).alias("vendor_id"), "r.name", "normalized_name", "r.country")
    return vendors.select("vendor_id", "name", "normalized_name", "country").unionByName(fresh)
