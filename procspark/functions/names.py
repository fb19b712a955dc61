"""Name cleaning and name-derived ids."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Legal-form words dropped from vendor names, placeholders, the DNS namespace of RFC 4122.
LEGAL_WORDS = ["private", "pvt", "limited", "ltd", "corp", "corporation", "inc", "co", "company", "llp"]
UNKNOWN_VENDOR_CLEAN = "unknown_vendor"
UNKNOWN_VENDOR = "UNKNOWN_VENDOR"
UNKNOWN_BUYER = "UNKNOWN_BUYER"
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


@F.pandas_udf(StringType())
def _decompose(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKD", t), na_action="ignore")


def nfkd(c: Column) -> Column:
    """Compatibility decomposition. ASCII is its own decomposition, so only other rows carry text to Python."""
    plain = F.length(c) == F.octet_length(c)
    return F.when(plain, c).otherwise(_decompose(F.when(~plain, c)))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def _or_placeholder(text: Column, placeholder: str) -> Column:
    """The placeholder for empty text, written so that the long expression is evaluated once."""
    return F.regexp_replace(text, "^$", placeholder)


def normalize_vendor_name(c: Column, strip_marks: bool = False) -> Column:
    """Lower case letters and digits without legal-form words; nothing left gives the placeholder.

    Accents become spaces, which existing ids depend on; ``strip_marks`` drops them instead.
    """
    text = nfkd(F.coalesce(c, F.lit("")))
    if strip_marks:
        text = F.regexp_replace(text, r"\p{M}", "")
    # the class [^a-z0-9\s] in two steps: a negated class with another one inside takes Java some twenty times as long
    text = F.regexp_replace(F.lower(text), r"(?!\s)[^a-z0-9]", " ")
    text = squeeze(F.regexp_replace(text, r"\b(" + "|".join(LEGAL_WORDS) + r")\b", ""))
    return _or_placeholder(text, UNKNOWN_VENDOR_CLEAN)


def normalize_vendor_name_loose(c: Column) -> Column:
    """Keeps legal-form words and letters of any script."""
    return squeeze(F.regexp_replace(F.lower(nfkd(F.coalesce(c, F.lit("")))), r"(?U)[^\w\s]", " "))


def normalize_buyer_name(c: Column) -> Column:
    text = squeeze(nfkd(F.coalesce(c, F.lit(""))))
    return _or_placeholder(text, UNKNOWN_BUYER)


def uuid5_dns(name: Column) -> Column:
    """Version-5 UUID in the DNS namespace, from the built-in SHA-1."""
    digest = F.sha1(F.concat(F.unhex(F.lit(DNS_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    dash = F.lit("-")
    return F.concat(F.substring(digest, 1, 8), dash, F.substring(digest, 9, 4), dash, F.lit("5"),
                    F.substring(digest, 14, 3), dash, variant, F.substring(digest, 18, 3), dash,
                    F.substring(digest, 21, 12))


def canonical_vendor_id(clean_name: Column) -> Column:
    return uuid5_dns(F.concat(F.lit("vendor:"), clean_name))
