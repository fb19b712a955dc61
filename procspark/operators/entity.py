"""Vendor names that mean the same vendor.

Similarity is the Ratcliff-Obershelp ratio 2M / (|a| + |b|), computed for batches of pairs (``functions/matching``). It is only
computed for candidate pairs, which share rare grams (``rare_grams``); the candidates are complete.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procspark.functions.matching import ratios
from procspark.functions.names import canonical_vendor_id, normalize_vendor_name
from procspark.operators import rare_grams
from procspark.session import cut

THRESHOLD = 0.88


@F.pandas_udf(T.DoubleType())
def name_similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """Not symmetric in general: ``left`` is the first sequence."""
    return pd.Series(ratios(left.tolist(), right.tolist()), dtype=float)


def clean_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """``clean, ord, variants``: distinct clean names, the place of their first occurrence, their spellings."""
    raw = df.groupBy(F.col(name).alias("raw")).agg(F.min(order).alias("ord"))
    return raw.withColumn("clean", normalize_vendor_name(F.col("raw"))).groupBy("clean").agg(
        F.min("ord").alias("ord"), F.count("*").alias("variants"))


def candidate_pairs(names: DataFrame, threshold: float = THRESHOLD, block_rows: int = 2_000) -> DataFrame:
    """Pairs of clean names that may reach the threshold, ``a`` the earlier one. No pair that does is missed."""
    others = [c for c in names.columns if c not in ("clean", "ord")]
    pairs = rare_grams.candidates(names.filter(F.length("clean") > 0), "clean", threshold, block_rows=block_rows)
    a_first = F.col("l_ord") < F.col("r_ord")
    first = lambda c: F.when(a_first, F.col(f"l{c}")).otherwise(F.col(f"r{c}")).alias(f"a{c}")
    second = lambda c: F.when(a_first, F.col(f"r{c}")).otherwise(F.col(f"l{c}")).alias(f"b{c}")
    return pairs.select(*[side(c) for c in ("", "_ord", *[f"_{c}" for c in others]) for side in (first, second)])


def scored_pairs(names: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Candidates with the ratio in both directions; those that reach the threshold in one of them."""
    both = candidate_pairs(names, threshold).withColumns(
        {"score": name_similarity("a", "b"), "score_back": name_similarity("b", "a")})
    return both.filter((F.col("score") >= threshold) | (F.col("score_back") >= threshold))


def pairwise_matches(df: DataFrame, name: str, order: str, threshold: float = THRESHOLD) -> DataFrame:
    """Matching pairs of names. Spellings with one clean form are given by count, as the row of that form with
    itself, instead of all pairs of copies; ``a_variants x b_variants`` raw pairs stand behind a row."""
    names = cut(clean_names(df, name, order))
    found = scored_pairs(names, threshold).filter(F.col("score") >= threshold)
    own = names.filter(F.col("variants") > 1).select(
        F.col("clean").alias("a"), F.col("clean").alias("b"), F.lit(1.0).alias("score"),
        F.col("variants").alias("a_variants"), F.col("variants").alias("b_variants"))
    return found.select("a", "b", F.round("score", 3).alias("score"), "a_variants", "b_variants").unionByName(own)


def cluster_vendors(df: DataFrame, name: str, order: str, threshold: float = THRESHOLD) -> DataFrame:
    """``clean, leader``: greedy clustering in order of first occurrence, in parallel rounds.

    A name joins the first earlier leader it matches and otherwise leads. That is the first maximal independent
    set in the given order: in each round, names whose earlier matches are all settled are settled too. Random
    orders need a logarithmic number of rounds, and no cluster is ever gathered in one task. Every round settles at least the first
    open name, so the rounds end for any input.
    """
    names = cut(clean_names(df, name, order))
    # direction: the later name is compared to the leader
    edges = cut(scored_pairs(names, threshold).filter(F.col("score_back") >= threshold).select("a", "b", "a_ord"))
    later = edges.select(F.col("b").alias("clean")).distinct()
    early = edges.select(F.col("a").alias("clean")).distinct()
    state = cut(early.unionByName(later).distinct().join(later.withColumn("open", F.lit(True)), "clean", "left").select(
        "clean", F.when(F.col("open"), "open").otherwise("leader").alias("status")))
    while not state.filter(F.col("status") == "open").isEmpty():
        todo = edges.join(state.filter(F.col("status") == "open").select(F.col("clean").alias("b")), "b", "left_semi")
        seen = todo.join(state.select(F.col("clean").alias("a"), F.col("status").alias("s")), "a").groupBy(
            F.col("b").alias("clean")).agg(F.max((F.col("s") == "leader").cast("int")).alias("led"),
                                           F.max((F.col("s") == "open").cast("int")).alias("waits"))
        new = F.when(F.col("led") == 1, "member").when(F.col("waits") == 0, "leader")
        state = cut(state.join(seen, "clean", "left").select("clean", F.coalesce(new, F.col("status")).alias("status")))
    leaders = state.filter(F.col("status") == "leader").select(F.col("clean").alias("a"))
    members = state.filter(F.col("status") == "member").select(F.col("clean").alias("b"))
    joined = edges.join(leaders, "a", "left_semi").join(members, "b", "left_semi").groupBy(F.col("b").alias("clean")).agg(
        F.min_by("a", "a_ord").alias("leader"))
    return names.select("clean").join(joined, "clean", "left").select("clean", F.coalesce("leader", "clean").alias("leader"))


def vendor_mapping(df: DataFrame, name: str, order: str, threshold: float = THRESHOLD) -> DataFrame:
    """``name, canonical_name, canonical_id`` of every distinct spelling."""
    clusters = cluster_vendors(df, name, order, threshold)
    raw = df.select(F.col(name).alias("name")).distinct().withColumn("clean", normalize_vendor_name(F.col("name")))
    return raw.join(clusters, "clean").select("name", F.col("leader").alias("canonical_name"),
                                              canonical_vendor_id(F.col("leader")).alias("canonical_id"))
