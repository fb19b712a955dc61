"""Money predicates on whole cents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Approval limits in dollars.
APPROVAL_LIMITS = [10_000, 25_000, 100_000, 250_000]


def near_limit(c: Column) -> Column:
    """Within five percent below an approval limit."""
    hit = F.lit(False)
    for limit in APPROVAL_LIMITS:
        hit = hit | ((c >= limit * 95) & (c < limit * 100))
    return hit


def is_round(c: Column) -> Column:
    """A multiple of 1,000, or of 500 from 10,000 up, to the cent."""
    return ((c >= 1_000_000) & (F.pmod(c, F.lit(50_000)) == 0)) | (F.pmod(c, F.lit(100_000)) == 0)
