"""Raw source payloads to rows, and rows of each source to the canonical schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procspark.functions.names import UNKNOWN_BUYER, UNKNOWN_VENDOR
from procspark.functions.values import first_of, json_amount, safe_timestamp, trimmed

# The keys under which feeds deliver their list of records, in order of preference.
RECORD_KEYS = ["records", "results", "data", "items", "tenders", "releases"]

CANONICAL = ["transaction_id", "buyer", "vendor", "amount", "currency", "timestamp", "source", "description",
             "category", "country", "raw"]


def extract_records(payloads: DataFrame, col: str = "payload") -> DataFrame:
    """One row per JSON object of a feed response: a bare list, or the first list under a known key."""
    body = F.col(col)
    wrapped = F.from_json(body, "struct<" + ",".join(f"{k}: array<string>" for k in RECORD_KEYS) + ">")
    bare = F.when(F.ltrim(body).startswith("["), F.from_json(body, "array<string>"))
    found = F.coalesce(bare, *[wrapped[k] for k in RECORD_KEYS])
    rows = payloads.select(*[c for c in payloads.columns if c != col], F.posexplode(found).alias("at", "raw"))
    return rows.filter(F.ltrim("raw").startswith("{"))


def jsonl_objects(lines: DataFrame, col: str = "value") -> DataFrame:
    """Lines that hold one JSON object; blank, broken and other lines are dropped."""
    text = F.trim(F.col(col))
    ok = text.startswith("{") & F.try_parse_json(text).isNotNull()
    return lines.filter(ok).withColumn(col, text)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Plain or gzip files (by suffix); undecodable bytes are replaced by the text reader."""
    return jsonl_objects(spark.read.text(path)).withColumnRenamed("value", "raw")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is parsed exactly once per row: as a generator output it is neither inlined into
    its many uses nor copied below by predicate pushdown."""
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


# amounts keep their JSON type: the number 0 says nothing, the text "0" is a value
_AMOUNTS = {"Award Amount", "award_amount", "value", "contract_value", "estimated_value"}


def _fields(*names: str) -> str:
    return "struct<" + ",".join(f"`{n}`: {'variant' if n in _AMOUNTS else 'string'}" for n in names) + ">"


def _canonical(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    keep = [c for c in df.columns if c not in cols and c not in ("raw", "p")]
    out = df.select(*keep, *[cols[c].alias(c) for c in CANONICAL if c in cols], F.col("raw"))
    return out.filter(F.col("transaction_id") != "")


def canonicalize_usa(df: DataFrame, ingest_ts: Column) -> DataFrame:
    p = F.from_json("raw", _fields(
        "Award ID", "award_id", "Award Amount", "award_amount", "Last Modified Date", "action_date",
        "Awarding Agency", "awarding_agency", "Recipient Name", "vendor_name", "Description", "NAICS Description",
        "Place of Performance Country Code"))
    df = once(df, "p", p)
    f = lambda name: F.col("p")[name]
    return _canonical(df, {
        "transaction_id": F.trim(first_of(f("Award ID"), f("award_id"), default="")),
        "buyer": trimmed(first_of(f("Awarding Agency"), f("awarding_agency")), UNKNOWN_BUYER),
        "vendor": trimmed(first_of(f("Recipient Name"), f("vendor_name")), UNKNOWN_VENDOR),
        "amount": json_amount(f("Award Amount"), f("award_amount")),
        "currency": F.lit("USD"),
        "timestamp": safe_timestamp(first_of(f("Last Modified Date"), f("action_date")), ingest_ts),
        "source": F.lit("USA"),
        "description": f("Description"),
        "category": f("NAICS Description"),
        "country": f("Place of Performance Country Code"),
    })


def canonicalize_cppp(df: DataFrame, ingest_ts: Column) -> DataFrame:
    p = F.from_json("raw", _fields(
        "tender_id", "id", "reference_no", "value", "contract_value", "estimated_value", "currency", "published_date",
        "date", "updated_at", "buyer", "department", "authority", "vendor", "awarded_to", "supplier", "description",
        "work_description", "category", "sector"))
    df = once(df, "p", p)
    f = lambda name: F.col("p")[name]
    return _canonical(df, {
        "transaction_id": F.trim(first_of(f("tender_id"), f("id"), f("reference_no"), default="")),
        "buyer": trimmed(first_of(f("buyer"), f("department"), f("authority")), UNKNOWN_BUYER),
        "vendor": trimmed(first_of(f("vendor"), f("awarded_to"), f("supplier")), UNKNOWN_VENDOR),
        "amount": json_amount(f("value"), f("contract_value"), f("estimated_value")),
        "currency": F.upper(first_of(f("currency"), default="INR")),
        "timestamp": safe_timestamp(first_of(f("published_date"), f("date"), f("updated_at")), ingest_ts),
        "source": F.lit("CPPP"),
        "description": first_of(f("description"), f("work_description")),
        "category": first_of(f("category"), f("sector")),
        "country": F.lit("IN"),
    })


_VALUE = "struct<amount: string, currency: string>"
_RELEASE = ("ocid: string, id: string, releaseID: string, date: string, publishedDate: string, description: string,"
            f"tender: struct<description: string, mainProcurementCategory: string, value: {_VALUE},"
            "  tenderPeriod: struct<startDate: string>>,"
            f"awards: array<struct<value: {_VALUE}, suppliers: array<struct<id: string, name: string>>>>,"
            f"contracts: array<struct<value: {_VALUE}>>,"
            "buyer: struct<name: string, address: struct<countryName: string, countryCode: string>>,"
            "parties: array<struct<id: string, name: string, roles: array<string>>>")
OCDS_SCHEMA = (f"struct<{_RELEASE}, releases: array<struct<{_RELEASE}>>,"
               f" records: array<struct<compiledRelease: struct<{_RELEASE}>>>>")


def _filled(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def _head(arr: Column, keep: Callable[[Column], Column]) -> Column:
    """The first array element that passes; null for none or no array."""
    return F.get(F.filter(arr, keep), F.lit(0))


def canonicalize_ocds(df: DataFrame, ingest_ts: Column) -> DataFrame:
    """Everything is read from the nested value with array functions, so no row is multiplied."""
    df = once(df, "p", F.from_json("raw", OCDS_SCHEMA))
    names = [f.name for f in df.schema["p"].dataType.fields if f.name not in ("releases", "records")]
    own = F.struct(*[F.col("p")[n].alias(n) for n in names])
    nested = F.coalesce(
        _head(F.col("p.releases"), lambda r: _filled(r["ocid"])),
        _head(F.col("p.records"), lambda r: _filled(r["compiledRelease"]["ocid"]))["compiledRelease"])
    df = once(df, "n", nested)
    df = once(df, "p", F.when(_filled(F.col("p.ocid")) | F.col("n").isNull(), own).otherwise(F.col("n"))).drop("n")
    priced = lambda b: b["value"]["amount"].isNotNull()
    value = F.coalesce(_head(F.col("p.contracts"), priced)["value"], _head(F.col("p.awards"), priced)["value"],
                       F.struct(F.coalesce("p.tender.value.amount", F.lit("0")).alias("amount"),
                                F.coalesce("p.tender.value.currency", F.lit("USD")).alias("currency")))
    suppliers = F.flatten(F.filter(F.transform("p.awards", lambda a: a["suppliers"]), lambda s: s.isNotNull()))
    ids = F.transform(F.filter(suppliers, lambda s: _filled(s["id"])), lambda s: s["id"])
    by_id = F.transform(ids, lambda i: F.try_element_at(
        F.filter("p.parties", lambda party: party["id"] == i), F.lit(-1))["name"])
    in_role = lambda party: _filled(party["name"]) & F.coalesce(
        F.exists(party["roles"], lambda r: F.lower(r) == "supplier"), F.lit(False))
    vendor = F.coalesce(_head(suppliers, lambda s: _filled(s["name"]))["name"], _head(by_id, _filled),
                        _head(F.col("p.parties"), in_role)["name"], F.lit(UNKNOWN_VENDOR))
    f = lambda name: F.col("p")[name]
    return _canonical(df, {
        "transaction_id": F.trim(first_of(f("ocid"), f("id"), f("releaseID"), default="")),
        "buyer": trimmed(F.col("p.buyer.name"), UNKNOWN_BUYER),
        "vendor": vendor,
        "amount": F.coalesce(value["amount"].try_cast("decimal(38,6)"), F.lit(0).cast("decimal(38,6)")),
        "currency": F.upper(first_of(value["currency"], default="USD")),
        "timestamp": safe_timestamp(first_of(f("date"), f("publishedDate"), F.col("p.tender.tenderPeriod.startDate")),
                                    ingest_ts),
        "source": F.lit("OCDS"),
        "description": first_of(F.col("p.tender.description"), f("description")),
        "category": F.col("p.tender.mainProcurementCategory"),
        "country": first_of(F.col("p.buyer.address.countryName"), F.col("p.buyer.address.countryCode")),
    })


# The extension point: a source is a name and a transform of raw rows to canonical rows.
Normalizer = Callable[[DataFrame, Column], DataFrame]
SOURCES: dict[str, Normalizer] = {
    "USA": canonicalize_usa,
    "CPPP": canonicalize_cppp,
    "OCDS": canonicalize_ocds,
}


def register_source(name: str, normalize: Normalizer) -> None:
    SOURCES[name] = normalize


def normalize_sources(feeds: dict[str, DataFrame], ingest_ts: Column) -> DataFrame:
    parts = [SOURCES[name](df, ingest_ts) for name, df in feeds.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# ---------------------------------------------------------------------------------------------
# catalogs and tender pages


def resource_urls(payloads: DataFrame, col: str = "payload", order: str = "page_id") -> DataFrame:
    """JSON resources of catalog responses; each url once, at its first position."""
    schema = "struct<result: struct<results: array<struct<resources: array<struct<url: string, format: string>>>>>>"
    packages = payloads.select(order, F.from_json(col, schema)["result"]["results"].alias("packages"))
    resources = packages.select(order, F.posexplode("packages").alias("p1", "package")).select(
        order, "p1", F.posexplode("package.resources").alias("p2", "r"))
    url = F.trim(F.coalesce("r.url", F.lit("")))
    wanted = F.lower(F.coalesce("r.format", F.lit(""))).isin("json", "jsonl", "ndjson") | F.lower(url).endswith(".json")
    return resources.filter((url != "") & wanted).groupBy(url.alias("url")).agg(
        F.min(F.struct(order, "p1", "p2")).alias("first_at"))


# One table row of four cells, and the date shapes a tender cell may show.
_ROW = (r"(?i)<tr[^>]*>\s*<td[^>]*>(.*?)</td>\s*<td[^>]*>(.*?)</td>\s*<td[^>]*>(.*?)</td>"
        r"\s*<td[^>]*>(.*?)</td>\s*</tr>")
_DATES = (r"\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b|\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}\s+[A-Za-z]{3,9}\s+\d{2,4}\b")
_MARK = "\u0001"
_ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]


def _plain(c: Column) -> Column:
    out = F.regexp_replace(c, r"<[^>]+>", " ")
    for name, char in _ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def html_tender_rows(pages: DataFrame, col: str = "html") -> DataFrame:
    """Plausible tenders from the four-cell table rows of each page."""
    keep = [c for c in pages.columns if c != col]
    flat = once(pages, "flat*", F.regexp_replace(F.coalesce(F.col(col), F.lit("")), r"\s+", " "))
    names, text = ("title", "ref", "closing", "opening"), F.col("`flat*`")
    each = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(_ROW), F.lit(i)).alias(n) for i, n in enumerate(names, 1)])
    # a page is searched once for its rows; a row is searched once for its cells, told apart by a mark that the page does not hold
    apart = F.transform(F.regexp_extract_all(text, F.lit(_ROW), F.lit(0)), lambda row: F.split(
        F.regexp_replace(row, _ROW, _MARK.join(f"${i}" for i in range(1, 5))), _MARK))
    fast = F.transform(apart, lambda c: F.struct(*[c[i].alias(n) for i, n in enumerate(names)]))
    groups = F.when(F.contains(text, F.lit(_MARK)), each).otherwise(fast)
    cells = F.struct(*[_plain(F.col(f"r.{n}")).alias(n) for n in names])
    # the conditions below read each cell many times
    rows = once(flat.select(*keep, F.posexplode(groups).alias("at", "r")), "r", cells).select(*keep, "at", "r.*")
    title, ref = F.col("title"), F.col("ref")
    plausible = (
        (ref != "") & ~F.lower(ref).isin("reference no", "reference")
        & (title != "") & ~F.lower(title).isin("tender title", "title")
        & ~ref.contains("|") & ~title.contains("|") & (F.length(ref) <= 80) & (F.length(title) <= 500)
        & ref.rlike(r"\d") & (F.col("closing").rlike(_DATES) | F.col("opening").rlike(_DATES))
    )
    return rows.filter(plausible).select(
        *keep, "at", ref.alias("tender_id"), title.alias("description"),
        F.coalesce(F.nullif(F.col("closing"), F.lit("")), F.col("opening")).alias("published_date"),
        F.col("opening").alias("updated_at"), F.lit("CPPP").alias("buyer"), F.lit(UNKNOWN_VENDOR).alias("vendor"),
        F.lit(0).alias("estimated_value"), F.lit("INR").alias("currency"))
