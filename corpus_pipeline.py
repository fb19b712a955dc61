"""From raw documents to packed training sequences: five stages, each on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procspark.llm import decontaminate, line_spread, packing, quality_bands, shingle_overlap
from procspark.llm.common import ready, tokenizer_path
from procspark.session import cut, tune
from procspark.sources.tables import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    ready(tune(spark))
    return quality_bands.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that stand on many sites; ``n_chars`` follows the text. Only what is nearly all such lines stays whole."""
    ready(tune(spark))
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    found = line_spread.strip_boilerplate(docs, keep=rest, most=0.9)
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles with a similarity of 0.8 or more."""
    ready(tune(spark))
    return shingle_overlap.keep_first(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ready(tune(spark))
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents with their places in sequences."""
    ready(tune(spark))
    limits = packing.Limits()
    return packing.pack(packing.tokenize(docs, tokenizer_path("word_bpe_49k.json"), tokens=limits.tokens), limits)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("simhash_near_dedup", near_copies), ("benchmark_decontamination", benchmark),
          ("best_fit_packing", packed)]
ORACLE_SQL = None  # compression ratios, SimHash bits and token ids have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
