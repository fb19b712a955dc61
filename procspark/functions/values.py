"""Scalar cleaning of raw values: first usable alternative, amounts, times, currencies, dimensions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units of US dollar per unit of currency.
USD_RATES = {"USD": "1.00", "INR": "0.012", "EUR": "1.09", "GBP": "1.28"}

_ISO_TIME = (r"^\s*\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?"
             r"(Z|[+-]\d{2}:?\d{2}(:?\d{2})?)?)?\s*$")


def first_of(*cols: Column, default: str | None = None) -> Column:
    """The first alternative that is neither null nor empty."""
    found = F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])
    return found if default is None else F.coalesce(found, F.lit(default))


def trimmed(c: Column, default: str) -> Column:
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(default))


def amount(*cols: Column) -> Column:
    """The first non-zero alternative as a decimal; text that is no number counts 0."""
    is_zero = lambda c: F.coalesce(c.try_cast("decimal(38,6)") == 0, F.lit(False))
    chosen = F.coalesce(*[F.when(~is_zero(c), F.nullif(c, F.lit(""))) for c in cols])
    return F.coalesce(chosen.try_cast("decimal(38,6)"), F.lit(0).cast("decimal(38,6)"))


def json_amount(*cols: Column) -> Column:
    """The first alternative that says something, as a decimal, from JSON values as variants.

    Missing, null, empty text and the number 0 say nothing; the text "0" is a value. Text that is no number counts 0.
    """
    def told(v: Column) -> Column:
        text = F.try_variant_get(v, "$", "string")
        quoted = F.schema_of_variant(v) == "STRING"
        return F.when(F.coalesce(F.when(quoted, text != "").otherwise(F.coalesce(text.try_cast("decimal(38,6)") != 0, text != "false")), F.lit(False)), text)

    return F.coalesce(F.coalesce(*[told(v) for v in cols]).try_cast("decimal(38,6)"), F.lit(0).cast("decimal(38,6)"))


def safe_timestamp(c: Column, ingest_ts: Column) -> Column:
    """ISO-8601 text as a time; without a zone it is UTC; anything else gives the ingest time."""
    return F.coalesce(F.when(c.rlike(_ISO_TIME), F.try_to_timestamp(F.trim(c))), ingest_ts)


def usd_amount(value: Column, currency: Column) -> Column:
    """Cents are rounded half-even; the amount of a currency without a rate passes through as it is."""
    code = F.upper(F.coalesce(currency, F.lit("USD")))
    out = value.cast("decimal(38,6)")
    for name, rate in USD_RATES.items():
        converted = F.bround(value * F.lit(rate).cast("decimal(6,3)"), 2)
        out = F.when(code == name, converted.cast("decimal(38,6)")).otherwise(out)
    return out


def amount_text(value: Column) -> Column:
    """A decimal as text with two places, or as many more as it needs."""
    return F.regexp_replace(value.cast("decimal(38,6)").cast("string"), r"(\.\d\d\d*?)0+$", "$1")


def usd_currency(currency: Column) -> Column:
    code = F.upper(F.coalesce(currency, F.lit("USD")))
    return F.when(code.isin(*USD_RATES), "USD").otherwise(code)


def map_source(c: Column) -> Column:
    """Accepted spellings of each source."""
    name = F.upper(F.trim(F.coalesce(c, F.lit(""))))
    return (
        F.when(name.isin("USA", "USASPENDING", "US"), "USASPENDING")
        .when(name.isin("CPPP", "INDIA_CPPP", "EPROCURE_GOV_IN"), "CPPP")
        .when(name.isin("OCDS", "OPEN_CONTRACTING"), "OCDS")
        .otherwise("MANUAL")
    )


# Source systems, agency families and category families; the first match wins.
SOURCE_SYSTEMS = {
    "USASPENDING": "US_FEDERAL",
    "CPPP": "INDIA_CPPP",
    "OCDS": "OPEN_CONTRACTING",
    "WORLDBANK": "INTERNATIONAL",
    "SEC_EDGAR": "CORPORATE_DISCLOSURES",
    "NYC_OPENDATA": "US_MUNICIPAL",
    "MANUAL": "MANUAL",
    "UNKNOWN": "UNKNOWN",
}
AGENCY_FAMILIES = [
    ("defense|army|navy|air force|dod", "DEFENSE"),
    ("health|hhs|medicare|nih", "HEALTH"),
    ("transport|dot|aviation|faa", "TRANSPORT"),
    ("energy|doe", "ENERGY"),
    ("homeland|dhs", "HOMELAND_SECURITY"),
    ("veterans|va", "VETERANS"),
    ("nasa", "SPACE"),
    ("treasury|irs", "TREASURY"),
    ("gsa", "GSA"),
]
CATEGORY_CODES = [
    (r"^54\d{2}", "PROFESSIONAL_SERVICES"),
    (r"^23\d{2}", "CONSTRUCTION"),
    (r"^48|^49", "LOGISTICS"),
    (r"^33|^31|^32", "MANUFACTURING"),
]
CATEGORY_WORDS = [
    ("computer|software|it|cloud|cyber", "INFORMATION_TECHNOLOGY"),
    ("construction|building|facility", "CONSTRUCTION"),
    ("consult|advisory|professional", "PROFESSIONAL_SERVICES"),
    ("medical|health|pharma|clinical", "HEALTHCARE"),
    ("transport|freight|shipping|logistics", "LOGISTICS"),
    ("research|engineering|scientific", "ENGINEERING_RND"),
]
# Short codes that sit inside ordinary words unless they must start and end at a word bound.
_SHORT = {"dod", "hhs", "nih", "dot", "faa", "doe", "dhs", "va", "nasa", "irs", "gsa", "it"}


def _bounded(pattern: str) -> str:
    return "|".join(rf"\b{w}\b" if w in _SHORT else w for w in pattern.split("|"))


def source_system(c: Column) -> Column:
    name = F.upper(F.coalesce(F.nullif(c, F.lit("")), F.lit("UNKNOWN")))
    table = F.create_map(*[F.lit(x) for pair in SOURCE_SYSTEMS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, name), name)


def _first_match(value: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    pairs = [(value.rlike(p), F.lit(family)) for p, family in rules]
    return reduce(lambda rest, pair: F.when(pair[0], pair[1]).otherwise(rest), reversed(pairs), F.lit(otherwise))


def agency_family(c: Column, compat: bool = False) -> Column:
    value = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    rules = AGENCY_FAMILIES if compat else [(_bounded(p), f) for p, f in AGENCY_FAMILIES]
    return F.when(value == "", "UNKNOWN").otherwise(_first_match(value, rules, "OTHER_FEDERAL"))


def category_family(c: Column, compat: bool = False) -> Column:
    """``compat`` keeps two known quirks: four-digit 54/23 codes never match, and short words match
    inside longer ones."""
    value = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    codes = CATEGORY_CODES[2:] if compat else CATEGORY_CODES
    words = CATEGORY_WORDS if compat else [(_bounded(p), f) for p, f in CATEGORY_WORDS]
    return F.when(value == "", "UNKNOWN").otherwise(_first_match(value, codes + words, "OTHER"))
