"""Shared helpers: session settings, words of a text, rows in Arrow batches.

Words are the longest runs of ``[^\\x20\\x09-\\x0D]``. ``bytes.split()`` cuts at exactly these six bytes, none of
which occurs inside a longer UTF-8 sequence, so texts are handled as UTF-8 bytes throughout.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows handed to Python at once: texts are whole, so a batch of very long ones must still fit a worker.
BATCH_CONF = {"spark.sql.execution.arrow.maxRecordsPerBatch": "512", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}
SPACE = "\\x20\\x09-\\x0D"


def ready(spark: SparkSession) -> SparkSession:
    """Small Arrow batches for this session."""
    for key, value in BATCH_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, looked up exactly, so extra columns with clashing names do no harm."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def raw(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8; null is empty."""
    return [b or b"" for b in batch.column(name).cast(pa.binary()).to_pylist()]


def id_bytes(value: int | None) -> bytes:
    return b"" if value is None else str(value).encode()


def held_out(value: int | None, folds: int = 7, fold: int = 2) -> bool:
    """Whether the row's ``crc32`` of its id as text falls in the fold kept from training."""
    return zlib.crc32(id_bytes(value)) % folds == fold


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``fn`` over every batch; ``None`` adds no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def ragged(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items of these lengths laid end to end: the item number and the place within it, of every element."""
    lengths = np.asarray(lengths, dtype=np.int64)
    item = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.cumsum(lengths) - lengths
    return item, np.arange(len(item)) - np.repeat(starts, lengths)


def hex_sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def tokenizer_path(name: str) -> str:
    """Where the installed vocabulary files are; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)
