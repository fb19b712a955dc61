"""Registered queries: sources, canonical records, cleaning, upserts.

The raw feeds are derived from the invoice lines: each line becomes a JSON payload whose keys, gaps and
damages depend on its line number, so that every branch of the parsers meets real rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procspark.functions import names, values
from procspark.operators import quality, upserts
from procspark.registry import query
from procspark.session import spread
from procspark.sources import awards, payloads, topics
from procspark.sources.tables import SPEND_SQL, cents, spend, table



def ingest_ts() -> Column:
    return F.lit("2030-01-01 00:00:00").cast("timestamp")


FEED_SQL = """
feed AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS tx_id,
         l_linenumber AS ln, l_partkey, l_orderkey, l_suppkey, s_name, s_nationkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
         l_shipdate AS ts, CASE l_returnflag WHEN 'A' THEN 'USA' WHEN 'N' THEN 'CPPP' ELSE 'OCDS' END AS src
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
)"""


def feed(spark: SparkSession, sf: str) -> DataFrame:
    c = cents("l_extendedprice")
    lines = table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", c).alias("tx_id"),
        F.col("l_linenumber").alias("ln"), "l_partkey", "l_orderkey", "l_suppkey", c.alias("cents"),
        F.col("l_shipdate").alias("ts"),
        F.when(F.col("l_returnflag") == "A", "USA").when(F.col("l_returnflag") == "N", "CPPP")
        .otherwise("OCDS").alias("src"))
    supplier = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return spread(lines).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).drop("s_suppkey")


def _text(c: str = "cents") -> Column:
    return (F.col(c).cast("decimal(18,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(18,2)").cast("string")


def even_line() -> Column:
    return F.col("ln") % 2 == 0


def day_text() -> Column:
    return F.date_format("ts", "yyyy-MM-dd")


def iso_text() -> Column:
    return F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")


def usa_raw(df: DataFrame) -> DataFrame:
    agency = F.concat(F.lit("Agency "), F.col("l_partkey") % 25)
    even = F.to_json(F.struct(
        F.col("tx_id").alias("Award ID"), (F.col("cents") / 100.0).alias("Award Amount"),
        F.concat("s_name", F.lit(", Ltd.")).alias("Recipient Name"), agency.alias("Awarding Agency"),
        day_text().alias("Last Modified Date"), F.lit("parts").alias("Description"),
        F.lit("computer systems").alias("NAICS Description"), F.lit("USA").alias("Place of Performance Country Code")))
    odd = F.to_json(F.struct(
        F.col("tx_id").alias("award_id"),
        F.when(F.col("ln") == 7, "n/a").otherwise(_text()).alias("award_amount"),
        F.when(F.col("ln") != 3, F.col("s_name")).alias("vendor_name"), F.lit("  ").alias("awarding_agency"),
        F.when(F.col("ln") == 5, "unknown").otherwise(iso_text()).alias("action_date")))
    return df.select("tx_id", F.when(even_line(), even).otherwise(odd).alias("raw"))


USA_SQL = """
usa AS (
  SELECT tx_id AS transaction_id,
    CASE WHEN ln % 2 = 0 THEN 'Agency ' || (l_partkey % 25) ELSE 'UNKNOWN_BUYER' END AS buyer,
    CASE WHEN ln % 2 = 0 THEN s_name || ', Ltd.' WHEN ln = 3 THEN 'UNKNOWN_VENDOR' ELSE s_name END AS vendor,
    CASE WHEN ln = 7 THEN 0 ELSE cents END AS cents, 'USD' AS currency,
    CASE WHEN ln = 5 THEN TIMESTAMP '2030-01-01' ELSE ts END AS "timestamp", 'USA' AS source,
    CASE WHEN ln % 2 = 0 THEN 'parts' END AS description,
    CASE WHEN ln % 2 = 0 THEN 'computer systems' END AS category,
    CASE WHEN ln % 2 = 0 THEN 'USA' END AS country
  FROM feed WHERE src = 'USA'
)"""


def cppp_raw(df: DataFrame) -> DataFrame:
    money = F.when(F.col("ln") % 3 == 1, "eur").when(F.col("ln") % 3 == 2, "JPY")
    even = F.to_json(F.struct(
        F.col("tx_id").alias("tender_id"), _text().alias("value"), money.alias("currency"),
        F.col("s_name").alias("vendor"), F.concat(F.lit("Dept  "), F.col("l_partkey") % 25).alias("department"),
        day_text().alias("published_date"), F.lit("roads").alias("work_description")))
    odd = F.to_json(F.struct(
        F.lit("").alias("tender_id"), F.concat(F.lit(" "), "tx_id").alias("id"), F.lit(0).alias("value"),
        (F.col("cents") / 100.0).alias("contract_value"), money.alias("currency"),
        F.col("s_name").alias("awarded_to"), iso_text().alias("date"), F.lit("civil").alias("sector")))
    return df.select("tx_id", F.when(even_line(), even).otherwise(odd).alias("raw"))


CPPP_SQL = """
cppp AS (
  SELECT tx_id AS transaction_id,
    CASE WHEN ln % 2 = 0 THEN 'Dept  ' || (l_partkey % 25) ELSE 'UNKNOWN_BUYER' END AS buyer, s_name AS vendor, cents,
    CASE ln % 3 WHEN 0 THEN 'INR' WHEN 1 THEN 'EUR' ELSE 'JPY' END AS currency, ts AS "timestamp", 'CPPP' AS source,
    CASE WHEN ln % 2 = 0 THEN 'roads' END AS description, CASE WHEN ln % 2 = 1 THEN 'civil' END AS category,
    'IN' AS country
  FROM feed WHERE src = 'CPPP'
)"""


def ocds_raw(df: DataFrame) -> DataFrame:
    ln = F.col("ln")
    priced = F.struct((F.col("cents") / 100.0).alias("amount"), F.lit("GBP").alias("currency"))
    no_price = F.lit(None).cast("struct<amount: double, currency: string>")
    sid = F.concat(F.lit("s"), "l_suppkey")
    supplier = F.struct(sid.alias("id"), F.when(ln % 2 == 0, F.col("s_name")).alias("name"))
    release = F.struct(
        F.col("tx_id").alias("ocid"),
        F.when(ln != 5, day_text()).alias("date"),
        F.array(F.struct(F.when(ln % 3 == 0, priced).otherwise(no_price).alias("value"))).alias("contracts"),
        F.array(F.struct(F.when(ln % 3 == 1, priced).otherwise(no_price).alias("value"),
                         F.when(ln != 7, F.array(supplier)).alias("suppliers"))).alias("awards"),
        F.struct(F.when(ln % 3 == 2, priced).otherwise(no_price).alias("value"), F.lit("works").alias("mainProcurementCategory"),
                 F.struct(iso_text().alias("startDate")).alias("tenderPeriod")).alias("tender"),
        F.struct(F.lit("Council").alias("name"), F.struct(F.lit("GB").alias("countryCode")).alias("address")).alias("buyer"),
        F.array(F.struct(F.lit("b1").alias("id"), F.lit("Council").alias("name"), F.array(F.lit("buyer")).alias("roles")),
                F.struct(sid.alias("id"), F.concat("s_name", F.lit(" Ltd")).alias("name"),
                         F.array(F.lit("Supplier")).alias("roles"))).alias("parties"))
    raw = (F.when(ln % 4 == 1, F.to_json(F.struct(F.array(release).alias("releases"))))
           .when(ln % 4 == 2, F.to_json(F.struct(F.array(F.struct(release.alias("compiledRelease"))).alias("records"))))
           .otherwise(F.to_json(release)))
    return df.select("tx_id", raw.alias("raw"))


OCDS_SQL = """
ocds AS (
  SELECT tx_id AS transaction_id, 'Council' AS buyer,
    CASE WHEN ln % 2 = 0 THEN s_name ELSE s_name || ' Ltd' END AS vendor, cents, 'GBP' AS currency, ts AS "timestamp",
    'OCDS' AS source, CAST(NULL AS VARCHAR) AS description, 'works' AS category, 'GB' AS country
  FROM feed WHERE src = 'OCDS'
)"""
SOURCES_SQL = "WITH " + ",".join([FEED_SQL, USA_SQL, CPPP_SQL, OCDS_SQL]) + """, canonical AS (
  SELECT * FROM usa UNION ALL SELECT * FROM cppp UNION ALL SELECT * FROM ocds)"""
_CANON = """transaction_id, buyer, vendor, cents / 100.0 AS amount, currency, "timestamp", source, description, category, country"""

RAW = {"USA": usa_raw, "CPPP": cppp_raw, "OCDS": ocds_raw}


def feeds(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    df = feed(spark, sf)
    return {name: make(df.filter(F.col("src") == name)).select("raw") for name, make in RAW.items()}


def canonical(spark: SparkSession, sf: str) -> DataFrame:
    return payloads.normalize_sources(feeds(spark, sf), ingest_ts())


def _show(df: DataFrame) -> DataFrame:
    return df.select("transaction_id", "buyer", "vendor", F.col("amount").cast("double").alias("amount"), "currency",
                     F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "source", "description", "category",
                     "country")


for _name, _cte in (("USA", "usa"), ("CPPP", "cppp"), ("OCDS", "ocds")):
    def _make(name: str) -> None:
        @query(f"canonicalize_{_cte}", SOURCES_SQL + f" SELECT {_CANON} FROM {_cte}")
        def _(spark: SparkSession, sf: str) -> DataFrame:
            return _show(payloads.SOURCES[name](feeds(spark, sf)[name], ingest_ts()))

    _make(_name)


@query("scan_json_payload", "WITH " + FEED_SQL + """
SELECT tx_id, CAST(n AS BIGINT) AS at FROM feed, (VALUES (0), (1)) v(n)""")
def _(spark, sf):
    df = feed(spark, sf)
    ln = F.col("ln")
    item = F.struct("tx_id", "ln")
    two = F.array(item, item)
    body = (F.when(ln % 3 == 0, F.to_json(two)).when(ln % 3 == 1, F.to_json(F.struct(two.alias("results"))))
            .otherwise(F.to_json(F.struct(F.lit("x").alias("data"), two.alias("tenders")))))
    # a bare number in front of the objects must not come out as a record
    body = F.when(ln == 3, F.concat(F.lit("[7,"), F.substring(body, F.lit(2), F.length(body)))).otherwise(body)
    rows = payloads.extract_records(df.select(body.alias("payload")))
    return rows.select(F.get_json_object("raw", "$.tx_id").alias("tx_id"),
                       (F.col("at") - F.when(F.get_json_object("raw", "$.ln") == "3", 1).otherwise(0))
                       .cast("bigint").alias("at"))


@query("scan_jsonl", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 10 > 2""")
def _(spark, sf):
    n = F.col("event_id") % 10
    lines = table(spark, sf, "events").select("event_id", F.when(n == 0, F.substring("props", 1, 4)).when(n == 1, "  ")
                                              .when(n == 2, "[1, 2]").otherwise(F.col("props")).alias("value"))
    return payloads.jsonl_objects(lines).select("event_id", F.get_json_object("value", "$.k").cast("bigint").alias("k"))


@query("resource_url_discovery", """
SELECT url FROM (SELECT url || '.json' AS url FROM pages UNION SELECT url FROM pages WHERE page_id % 2 = 0)""")
def _(spark, sf):
    r = lambda url, fmt: F.struct(url.alias("url"), fmt.alias("format"))
    even = F.when(F.col("page_id") % 2 == 0, "NDJSON").otherwise("html")
    package = F.struct(F.array(r(F.concat(F.lit(" "), "url"), even), r(F.concat("url", F.lit(".json")), F.lit("csv")),
                               r(F.concat("url", F.lit(".json")), F.lit("json"))).alias("resources"))
    body = F.to_json(F.struct(F.struct(F.array(package).alias("results")).alias("result")))
    return payloads.resource_urls(
        table(spark, sf, "pages").select("page_id", body.alias("payload"))).select("url")


@query("html_tender_rows", "WITH " + FEED_SQL + """
SELECT 'REF/' || tx_id AS tender_id, 'Supply & ' || s_name AS description, strftime(ts, '%d-%m-%Y') AS published_date,
       strftime(ts, '%Y-%m-%d') AS updated_at
FROM feed WHERE src = 'CPPP' AND ln <> 4""")
def _(spark, sf):
    cell = lambda c: F.concat(F.lit("<td class='c'>"), c, F.lit("</td>"))
    row = lambda *cs: F.concat(F.lit("<tr>\n "), *[cell(c) for c in cs], F.lit(" </tr>"))
    header = row(F.lit("Tender Title"), F.lit("Reference No"), F.lit("Closing 01-01-2020"), F.lit("Opening"))
    ref = F.when(F.col("ln") == 4, F.lit("no number here")).otherwise(F.concat(F.lit("REF/"), "tx_id"))
    body = row(F.concat(F.lit("<b>Supply</b> &amp; "), "s_name"), ref, F.date_format("ts", "dd-MM-yyyy"),
               F.concat(day_text(), F.lit("&nbsp;")))
    pages = feed(spark, sf).filter(F.col("src") == "CPPP").select(
        F.concat(F.lit("<html><table>"), header, body, row(F.lit("x"), F.lit("A|1"), F.lit("1-1-2020"), F.lit("y")),
                 F.lit("</table></html>")).alias("html"))
    return payloads.html_tender_rows(pages).select("tender_id", "description", "published_date", "updated_at")


# ---------------------------------------------------------------------------------------------
# scalar cleaning


@query("safe_timestamp", "WITH " + FEED_SQL + """
SELECT tx_id, CASE ln WHEN 1 THEN ts WHEN 2 THEN ts WHEN 3 THEN ts - INTERVAL 330 MINUTE WHEN 4 THEN ts
              ELSE TIMESTAMP '2030-01-01' END AS at FROM feed""")
def _(spark, sf):
    text = (F.when(F.col("ln") == 1, day_text()).when(F.col("ln") == 2, iso_text())
            .when(F.col("ln") == 3, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+05:30'"))
            .when(F.col("ln") == 4, F.date_format("ts", "yyyy-MM-dd HH:mm")).when(F.col("ln") == 5, "soon")
            .when(F.col("ln") == 6, F.date_format("ts", "yyyy")))
    return feed(spark, sf).select("tx_id", values.safe_timestamp(text, ingest_ts()).cast("timestamp_ntz").alias("at"))


NAME_TEXT = """CASE l_suppkey % 4 WHEN 0 THEN s_name || ', Ltd.' WHEN 1 THEN 'The ' || s_name || ' Company (Pvt) Limited'
  WHEN 2 THEN '  ' || upper(s_name) || '&Co' ELSE 'Corp. Inc.' END"""


def vendor_text() -> Column:
    k, n = F.col("l_suppkey") % 4, F.col("s_name")
    return (F.when(k == 0, F.concat(n, F.lit(", Ltd."))).when(k == 1, F.concat(F.lit("The "), n, F.lit(" Company (Pvt) Limited")))
            .when(k == 2, F.concat(F.lit("  "), F.upper(n), F.lit("&Co"))).otherwise("Corp. Inc."))


CLEAN_SQL = """coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9\\s]', ' ', 'g'),
  '\\b(private|pvt|limited|ltd|corp|corporation|inc|co|company|llp)\\b', '', 'g'), '\\s+', ' ', 'g')), ''), 'unknown_vendor')"""


@query("normalize_vendor_name", "WITH " + FEED_SQL + f"SELECT tx_id, {CLEAN_SQL.format(NAME_TEXT)} AS vendor FROM feed")
def _(spark, sf):
    return feed(spark, sf).select("tx_id", names.normalize_vendor_name(vendor_text()).alias("vendor"))


@query("normalize_vendor_name_loose", "WITH " + FEED_SQL + f"""
SELECT tx_id, trim(regexp_replace(regexp_replace(lower({NAME_TEXT}), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS vendor FROM feed""")
def _(spark, sf):
    return feed(spark, sf).select("tx_id", names.normalize_vendor_name_loose(vendor_text()).alias("vendor"))


@query("normalize_document_names")
def _(spark, sf):
    """Accented text of whole documents through the decomposition; no DuckDB form of NFKD exists."""
    return table(spark, sf, "documents").select(
        "doc_id", names.normalize_vendor_name(F.col("text")).alias("clean"),
        names.normalize_vendor_name(F.col("text"), strip_marks=True).alias("clean_without_marks"))


@query("canonical_vendor_id", """
SELECT s_suppkey AS vendor_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-'
  || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid
FROM (SELECT s_suppkey, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('vendor:' || replace(lower(s_name), '#', ' '))) AS h
      FROM supplier)""")
def _(spark, sf):
    clean = names.normalize_vendor_name(F.col("s_name"))
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("vendor_id"),
                                               names.canonical_vendor_id(clean).alias("uuid"))


@query("normalize_buyer_name", """
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'UNKNOWN_BUYER' ELSE 'Office ' || o_orderpriority END AS buyer FROM orders""")
def _(spark, sf):
    text = F.when(F.col("o_orderkey") % 7 == 0, " \t ").otherwise(F.concat(F.lit(" Office \n  "), "o_orderpriority", F.lit(" ")))
    return table(spark, sf, "orders").select("o_orderkey", names.normalize_buyer_name(text).alias("buyer"))


# half-even rounding of cents * rate in whole numbers: the quotient moves up past the half, or at it if odd
HALF_EVEN = """CASE WHEN ({n}) % {d} * 2 > {d} OR (({n}) % {d} * 2 = {d} AND (({n}) // {d}) % 2 = 1)
  THEN ({n}) // {d} + 1 ELSE ({n}) // {d} END"""
USD_CENTS = ("CASE currency WHEN 'INR' THEN " + HALF_EVEN.format(n="cents * 12", d=1000) + " WHEN 'EUR' THEN "
             + HALF_EVEN.format(n="cents * 109", d=100) + " WHEN 'GBP' THEN " + HALF_EVEN.format(n="cents * 128", d=100)
             + " ELSE cents END")


@query("convert_to_usd", SOURCES_SQL + f"""
SELECT transaction_id, {USD_CENTS} / 100.0 AS amount, CASE WHEN currency = 'JPY' THEN 'JPY' ELSE 'USD' END AS currency
FROM canonical""")
def _(spark, sf):
    return quality.convert_to_usd(canonical(spark, sf)).select(
        "transaction_id", F.col("amount").cast("double").alias("amount"), "currency")


@query("handle_missing_fields", """
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'UNKNOWN_VENDOR' ELSE 'v' END AS vendor,
  CASE WHEN o_orderkey % 3 = 0 THEN 'UNKNOWN_BUYER' ELSE 'A b' END AS buyer,
  CASE WHEN o_orderkey % 5 = 0 THEN 0.0 ELSE round(o_totalprice, 2) END AS amount,
  CASE WHEN o_orderkey % 7 = 0 THEN 'USD' ELSE 'EUR' END AS currency FROM orders""")
def _(spark, sf):
    k = F.col("o_orderkey")
    df = table(spark, sf, "orders").select(
        "o_orderkey", F.when(k % 2 == 1, "v").otherwise("").alias("vendor"), F.when(k % 3 != 0, " A  b ").alias("buyer"),
        F.when(k % 5 == 0, "abc").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("amount"),
        F.when(k % 7 != 0, "eur").alias("currency"))
    return quality.handle_missing_fields(df).select("o_orderkey", "vendor", "buyer", F.col("amount").cast("double").alias("amount"),
                                                    "currency")


CLEANED_SQL = SOURCES_SQL + f""", cleaned AS (
  SELECT transaction_id, trim(regexp_replace(buyer, '\\s+', ' ', 'g')) AS buyer, {CLEAN_SQL.format("vendor")} AS vendor,
         {USD_CENTS} AS cents, CASE WHEN currency = 'JPY' THEN 'JPY' ELSE 'USD' END AS currency, "timestamp", source, description,
         category, country
  FROM canonical)"""
PRINT_SQL = """sha256(concat_ws('|', lower(trim(transaction_id)), vendor, lower(buyer), CAST(CAST(cents / 100.0 AS DECIMAL(18,2)) AS VARCHAR),
  strftime("timestamp", '%Y-%m-%d'), upper(source)))"""


def cleaned_fields(spark: SparkSession, sf: str) -> DataFrame:
    df = quality.handle_missing_fields(canonical(spark, sf))
    return quality.convert_to_usd(df.withColumn("vendor", names.normalize_vendor_name(F.col("vendor"))))


@query("record_fingerprint", CLEANED_SQL + f" SELECT transaction_id, {PRINT_SQL} AS fingerprint FROM cleaned")
def _(spark, sf):
    return cleaned_fields(spark, sf).select("transaction_id", quality.record_fingerprint().alias("fingerprint"))


# copies: the id is cut down to the order, and every fifth line loses it
@query("dedup_records", CLEANED_SQL + f""", d AS (
  SELECT CASE WHEN transaction_id LIKE '%5' THEN '' ELSE split_part(transaction_id, '-', 1) END AS short, transaction_id AS arrival, *
  FROM cleaned), k AS (
  SELECT *, coalesce('i:' || nullif(short, ''), 'f:' || {PRINT_SQL.replace("transaction_id", "short")}) AS key FROM d)
SELECT short AS transaction_id, arrival, vendor, cents / 100.0 AS amount FROM k
QUALIFY row_number() OVER (PARTITION BY key ORDER BY arrival) = 1""")
def _(spark, sf):
    df = cleaned_fields(spark, sf).drop("raw").withColumn("arrival", F.col("transaction_id"))
    short = F.when(F.col("arrival").endswith("5"), "").otherwise(F.concat(F.lit(" "), F.substring_index("arrival", "-", 1)))
    out = quality.dedup_records(df.withColumn("transaction_id", short), ["arrival"])
    return out.select(F.trim("transaction_id").alias("transaction_id"), "arrival", "vendor",
                      F.col("amount").cast("double").alias("amount"))


@query("clean_records", CLEANED_SQL + """
SELECT transaction_id, buyer, vendor, cents / 100.0 AS amount, currency, "timestamp", source, description, category, country FROM cleaned""")
def _(spark, sf):
    return _show(quality.clean_records(canonical(spark, sf).drop("raw"), ["transaction_id", "source"]))


CHANGED_SQL = """(ln = 1 OR ln = 2)"""


@query("change_detect", "WITH " + FEED_SQL + """
SELECT src || ':' || tx_id AS change_key FROM feed WHERE ln IN (1, 2)""")
def _(spark, sf):
    """The stored state misses line 1 and knows another amount for line 2."""
    now = feed(spark, sf).select(F.col("tx_id").alias("transaction_id"), F.col("s_name").alias("vendor"),
                                 F.col("cents").alias("amount"), F.col("src").alias("source"), "ln")
    before = now.filter(F.col("ln") != 1).withColumn(
        "amount", F.when(F.col("ln") == 2, F.col("amount") + 1).otherwise(F.col("amount")))
    changed, _ = quality.change_detect(now, quality.with_digest(before).select("change_key", "digest"))
    return changed.select("change_key")


@query("ingest_stats", CLEANED_SQL + """
SELECT source, count(*) AS polled, count(*) AS normalized, count(*) FILTER (WHERE currency <> 'JPY') AS changed,
       count(*) FILTER (WHERE currency <> 'JPY') AS published FROM cleaned GROUP BY source""")
def _(spark, sf):
    raw = None
    for name, df in feeds(spark, sf).items():
        part = df.select(F.lit(name).alias("source"))
        raw = part if raw is None else raw.unionByName(part)
    clean = quality.clean_records(canonical(spark, sf).drop("raw"), ["transaction_id", "source"])  # the payload would go along with its record
    return quality.ingest_stats(raw, clean, clean.filter(F.col("currency") != "JPY"))


FAMILY_SQL = r"""
  CASE source WHEN 'USASPENDING' THEN 'US_FEDERAL' WHEN 'CPPP' THEN 'INDIA_CPPP' WHEN 'OCDS' THEN 'OPEN_CONTRACTING' ELSE source END AS source_system,
  CASE WHEN regexp_matches(a, 'defense|army|navy|air force|\bdod\b') THEN 'DEFENSE' WHEN regexp_matches(a, 'health|\bhhs\b|medicare|\bnih\b') THEN 'HEALTH'
       WHEN regexp_matches(a, 'transport|\bdot\b|aviation|\bfaa\b') THEN 'TRANSPORT' WHEN regexp_matches(a, 'energy|\bdoe\b') THEN 'ENERGY'
       WHEN regexp_matches(a, 'homeland|\bdhs\b') THEN 'HOMELAND_SECURITY' WHEN regexp_matches(a, 'veterans|\bva\b') THEN 'VETERANS'
       WHEN regexp_matches(a, '\bnasa\b') THEN 'SPACE' WHEN regexp_matches(a, 'treasury|\birs\b') THEN 'TREASURY'
       WHEN regexp_matches(a, '\bgsa\b') THEN 'GSA' WHEN a = '' THEN 'UNKNOWN' ELSE 'OTHER_FEDERAL' END AS agency_family,
  CASE WHEN regexp_matches(c, '^54\d{2}') THEN 'PROFESSIONAL_SERVICES' WHEN regexp_matches(c, '^23\d{2}') THEN 'CONSTRUCTION'
       WHEN regexp_matches(c, '^48|^49') THEN 'LOGISTICS' WHEN regexp_matches(c, '^33|^31|^32') THEN 'MANUFACTURING'
       WHEN regexp_matches(c, 'computer|software|\bit\b|cloud|cyber') THEN 'INFORMATION_TECHNOLOGY'
       WHEN regexp_matches(c, 'construction|building|facility') THEN 'CONSTRUCTION' WHEN regexp_matches(c, 'consult|advisory|professional') THEN 'PROFESSIONAL_SERVICES'
       WHEN regexp_matches(c, 'medical|health|pharma|clinical') THEN 'HEALTHCARE' WHEN regexp_matches(c, 'transport|freight|shipping|logistics') THEN 'LOGISTICS'
       WHEN regexp_matches(c, 'research|engineering|scientific') THEN 'ENGINEERING_RND' WHEN c = '' THEN 'UNKNOWN' ELSE 'OTHER' END AS category_family"""
# agencies and categories as free text, one variant per part and nation
AGENCY_TEXT = """CASE l_partkey % 8 WHEN 0 THEN 'Department of Defense' WHEN 1 THEN 'HHS' WHEN 2 THEN 'DOT Aviation' WHEN 3 THEN 'Dept of Energy'
  WHEN 4 THEN 'VA Hospitals' WHEN 5 THEN 'Savannah Council' WHEN 6 THEN 'NASA' ELSE '' END"""
CATEGORY_TEXT = """CASE l_orderkey % 7 WHEN 0 THEN '541511' WHEN 1 THEN '2362' WHEN 2 THEN 'Facility upkeep' WHEN 3 THEN 'IT support' WHEN 4 THEN '484110'
  WHEN 5 THEN 'Clinical trials' ELSE description END"""
DIMS_SQL = "WITH " + SPEND_SQL + f""", texts AS (SELECT *, lower({AGENCY_TEXT}) AS a, lower({CATEGORY_TEXT}) AS c FROM spend),
dims AS (SELECT *, {FAMILY_SQL} FROM texts)"""


def agency_text() -> Column:
    return _cases(F.col("l_partkey") % 8, ["Department of Defense", "HHS", "DOT Aviation", "Dept of Energy", "VA Hospitals",
                                           "Savannah Council", "NASA"], F.lit(""))


def category_text() -> Column:
    return _cases(F.col("l_orderkey") % 7, ["541511", "2362", "Facility upkeep", "IT support", "484110", "Clinical trials"],
                  F.col("description"))


def _cases(k: Column, texts: list[str], last: Column) -> Column:
    out = last
    for i, t in reversed(list(enumerate(texts))):
        out = F.when(k == i, t).otherwise(out)
    return out


@query("source_dimensions", DIMS_SQL + " SELECT tx_id, source_system, agency_family, category_family FROM dims")
def _(spark, sf):
    return spend(spark, sf, category=True, agency=True).select(
        "tx_id", values.source_system(F.col("source")).alias("source_system"),
        values.agency_family(agency_text()).alias("agency_family"),
        values.category_family(category_text()).alias("category_family"))


@query("map_source", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'USASPENDING' WHEN 1 THEN 'CPPP' WHEN 2 THEN 'OCDS' ELSE 'MANUAL' END AS source FROM events""")
def _(spark, sf):
    text = _cases(F.col("event_id") % 4, [" us ", "india_cppp", "Open_Contracting"], F.col("event_type"))
    return table(spark, sf, "events").select("event_id", values.map_source(text).alias("source"))


# ---------------------------------------------------------------------------------------------
# awards

AWARD_SQL = """
award AS (
  SELECT tx_id AS external_id, CASE WHEN ln = 3 THEN 'UNKNOWN VENDOR' ELSE s_name END AS vendor_name,
    CASE WHEN ln % 2 = 0 THEN 'UEI' || l_suppkey END AS vendor_uei, CASE WHEN ln = 6 THEN NULL ELSE 'USA' END AS vendor_country,
    CASE WHEN ln IN (3, 5, 7) THEN 0.0 ELSE cents / 100.0 END AS amount, ts AS action_date, CAST(year(ts) AS INTEGER) AS fiscal_year,
    chr(CAST(65 + l_partkey % 6 AS INTEGER)) AS award_type, src, ln, l_partkey, l_orderkey
  FROM feed WHERE src = 'USA'
)"""


def award_rows(spark: SparkSession, sf: str) -> DataFrame:
    ln = F.col("ln")
    raw = F.to_json(F.struct(
        F.col("tx_id").alias("Award ID"), F.when(ln != 3, F.col("s_name")).alias("Recipient Name"),
        F.when(ln % 2 == 0, F.concat(F.lit("UEI"), "l_suppkey")).alias("Recipient DUNS Number"),
        F.when(ln != 6, "USA").alias("Place of Performance Country Code"),
        F.when(ln == 7, "bad").when(ln % 2 == 0, _text()).otherwise("0").alias("Award Amount"),
        _text().alias("Total Outlays"), day_text().alias("Last Modified Date"), F.year("ts").alias("Fiscal Year"),
        F.char(F.lit(65) + F.col("l_partkey") % 6).alias("Award Type")))
    # line 1 has the number 0, which gives way to the outlays, lines 3 and 5 the text "0", which is an amount
    raw = F.when(ln == 1, F.replace(raw, F.lit('"Award Amount":"0"'), F.lit('"Award Amount":0'))).otherwise(raw)
    rows = feed(spark, sf).filter(F.col("src") == "USA").select("l_partkey", "l_orderkey", "ln", raw.alias("raw"))
    return awards.parse_award_record(rows, ingest_ts())


_AWARD = "external_id, vendor_name, vendor_uei, vendor_country, amount, action_date, fiscal_year, award_type"


def _award_view(df: DataFrame) -> DataFrame:
    return df.select("external_id", "vendor_name", "vendor_uei", "vendor_country", "amount",
                     F.col("action_date").cast("timestamp_ntz").alias("action_date"), "fiscal_year", "award_type")


@query("parse_award_record", "WITH " + FEED_SQL + "," + AWARD_SQL + f"SELECT {_AWARD} FROM award")
def _(spark, sf):
    return _award_view(award_rows(spark, sf))


@query("award_filter", "WITH " + FEED_SQL + "," + AWARD_SQL + f"""
SELECT {_AWARD} FROM award WHERE action_date BETWEEN DATE '1997-01-01' AND DATE '1999-06-30'
  AND award_type IN ('A', 'B', 'C', 'D') AND amount >= 1000""")
def _(spark, sf):
    return _award_view(awards.award_filter(award_rows(spark, sf), "1997-01-01", "1999-06-30"))


# award codes of the test rows: every third part is an IT award, others construction, logistics or none
GRID_YEARS = [(f"{y}-01-01", f"{y}-12-31") for y in range(1996, 2001)]


@query("sector_year_grid", "WITH " + FEED_SQL + "," + AWARD_SQL + """, c AS (
  SELECT *, CASE l_partkey % 3 WHEN 0 THEN 'information_technology' WHEN 1 THEN 'construction' ELSE 'logistics_transport' END AS sector
  FROM award WHERE l_orderkey % 4 <> 0)
SELECT external_id, sector, sector || '|' || year(action_date) AS combo, amount FROM c
WHERE year(action_date) BETWEEN 1996 AND 2000 AND NOT (sector = 'construction' AND year(action_date) = 1998)""")
def _(spark, sf):
    code = F.when(F.col("l_orderkey") % 4 == 0, "999999").otherwise(
        _cases(F.col("l_partkey") % 3, ["541512", "236220"], F.lit("492110")))
    done = spark.createDataFrame([("construction|1998",)], "combo string")
    df = award_rows(spark, sf).withColumn("naics", code).select("external_id", "naics", "action_date", "amount")
    return awards.sector_year_grid(df, done, GRID_YEARS).select("external_id", "sector", "combo", "amount")


# ---------------------------------------------------------------------------------------------
# upserts; the stored table is the lines shipped before 1999, the batch the rest and some corrections


@query("upsert_latest", """
WITH t AS (SELECT l_orderkey AS k, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, l_shipdate AS ts,
                  concat_ws('-', l_linenumber, l_partkey, l_suppkey) AS seq, l_linestatus = 'F' AS scored FROM lineitem),
stored AS (SELECT k, max_by(cents, (ts, seq)) AS cents, max_by(scored, (ts, seq)) AS scored FROM t WHERE ts < TIMESTAMP '1999-01-01' GROUP BY k),
batch AS (SELECT k, max_by(cents, (ts, seq)) AS cents FROM t WHERE ts >= TIMESTAMP '1999-01-01' GROUP BY k)
SELECT coalesce(b.k, s.k) AS external_id, coalesce(b.cents, s.cents) AS cents, CASE WHEN b.k IS NULL THEN s.scored ELSE FALSE END AS is_scored
FROM stored s FULL JOIN batch b ON s.k = b.k""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("external_id"), cents("l_extendedprice").alias("cents"), F.col("l_shipdate").alias("ts"),
        F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("seq"), (F.col("l_linestatus") == "F").alias("is_scored"))
    old = F.col("ts") < F.lit("1999-01-01").cast("timestamp_ntz")
    stored = upserts.latest(rows.filter(old), "external_id", ["ts", "seq"]).drop("ts", "seq")
    return upserts.upsert_latest(stored, rows.filter(~old), "external_id", ["ts", "seq"], {"is_scored": F.lit(False)})


@query("insert_if_absent", """
WITH t AS (SELECT l_orderkey AS k, CASE WHEN l_linenumber = 2 THEN 0 ELSE CAST(round(l_extendedprice * 100) AS BIGINT) END AS amount, l_shipdate AS ts,
                  concat_ws('-', l_linenumber, l_partkey, l_suppkey) AS seq FROM lineitem)
SELECT k AS external_id, min_by(amount, (ts, seq)) AS amount FROM t
WHERE ts >= TIMESTAMP '1996-01-01' AND amount > 0 AND k NOT IN (SELECT k FROM t WHERE ts < TIMESTAMP '1996-01-01') GROUP BY k""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("external_id"),
        F.when(F.col("l_linenumber") == 2, 0).otherwise(cents("l_extendedprice")).alias("amount"), F.col("l_shipdate").alias("ts"),
        F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("seq"))
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    fresh = upserts.insert_if_absent(rows.filter(F.col("ts") < at("1996-01-01")), rows.filter(F.col("ts") >= at("1996-01-01")),
                                     "external_id", ["ts", "seq"])
    return fresh.select(F.col("external_id").cast("bigint").alias("external_id"), "amount")


def stored_vendors(spark: SparkSession, sf: str, part: Column) -> DataFrame:
    clean = names.normalize_vendor_name_loose(F.col("s_name"))
    return table(spark, sf, "supplier").filter(part).select(
        names.canonical_vendor_id(clean).alias("vendor_id"), F.col("s_name").alias("name"), clean.alias("normalized_name"),
        F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("UEI"), "s_suppkey")).alias("duns_number"),
        F.when(F.col("s_suppkey") % 4 == 0, "CAN").alias("country"))


@query("upsert_vendor", "WITH " + FEED_SQL + "," + AWARD_SQL + """, stored AS (
  SELECT s_suppkey AS k, replace(lower(s_name), '#', ' ') AS normalized_name, CASE WHEN s_suppkey % 2 = 0 THEN 'UEI' || s_suppkey END AS duns_number,
         CASE WHEN s_suppkey % 4 = 0 THEN 'CAN' END AS country FROM supplier WHERE s_suppkey % 3 <> 0),
rec AS (SELECT *, replace(lower(vendor_name), '#', ' ') AS loose, CAST(split_part(external_id, '-', 4) AS BIGINT) AS k FROM award),
-- a record without a name can only meet the stored vendor of its number, otherwise it is the shared placeholder vendor
placed AS (SELECT r.*, CASE WHEN s.k IS NOT NULL THEN s.normalized_name ELSE loose END AS vendor
           FROM rec r LEFT JOIN stored s ON r.vendor_uei = s.duns_number),
seen AS (SELECT vendor, min_by(vendor_country, external_id) FILTER (WHERE vendor_country IS NOT NULL) AS seen,
                min_by(vendor_uei, external_id) AS u, any_value(external_id) AS e FROM placed GROUP BY vendor)
SELECT coalesce(s.normalized_name, p.vendor) AS normalized_name, coalesce(s.country, p.seen) AS country
FROM stored s FULL JOIN seen p ON s.normalized_name = p.vendor""")
def _(spark, sf):
    vendors, _ = upserts.upsert_vendor(stored_vendors(spark, sf, F.col("s_suppkey") % 3 != 0),
                                       award_rows(spark, sf).select("external_id", "vendor_name", "vendor_uei", "vendor_country"),
                                       ["external_id"])
    return vendors.select("normalized_name", "country")


@query("vendor_dim_upsert", """
SELECT replace(lower(s_name), '#', ' ') AS normalized_name,
       CASE WHEN s_suppkey % 3 <> 0 THEN CASE WHEN s_suppkey % 4 = 0 THEN 'CAN' END ELSE 'USA' END AS country
FROM supplier WHERE s_suppkey % 3 <> 0 OR s_suppkey IN (SELECT l_suppkey FROM lineitem)""")
def _(spark, sf):
    records = feed(spark, sf).select(F.concat(F.lit(" "), "s_name", F.lit(" Ltd")).alias("vendor"), F.lit(" USA ").alias("country"), "tx_id")
    return upserts.vendor_dim_upsert(stored_vendors(spark, sf, F.col("s_suppkey") % 3 != 0), records, ["tx_id"]).select(
        "normalized_name", "country")


# ---------------------------------------------------------------------------------------------
# topics (S8-S10): the envelopes as they are written and read back


@query("raw_topic_sink", "WITH " + FEED_SQL + """
SELECT tx_id AS key, 'TRANSACTION_CREATED' AS event_type, tx_id AS transaction_id, s_name AS vendor, cents / 100.0 AS amount FROM feed""")
def _(spark, sf):
    out = topics.to_event(feed(spark, sf).select(F.col("tx_id").alias("transaction_id"), F.col("s_name").alias("vendor"),
                                                 (F.col("cents") / 100.0).alias("amount")), "raw_transactions")
    f = lambda p: F.get_json_object("value", f"$.{p}")
    return out.select("key", f("event_type").alias("event_type"), f("transaction_id").alias("transaction_id"),
                      f("vendor").alias("vendor"), f("amount").cast("double").alias("amount"))


@query("raw_topic_source", "WITH " + FEED_SQL + """
SELECT tx_id AS transaction_id, s_name AS vendor, cents / 100.0 AS amount FROM feed WHERE ln NOT IN (3, 5)""")
def _(spark, sf):
    """Line 3 is cut in transport and line 5 has no id: both leave through the dead-letter side."""
    df = feed(spark, sf).select(F.when(F.col("ln") != 5, F.col("tx_id")).alias("transaction_id"), F.col("s_name").alias("vendor"),
                                (F.col("cents") / 100.0).alias("amount"), "ln")
    sent = topics.to_event(df, "raw_transactions").withColumn(
        "value", F.when(F.get_json_object("value", "$.ln") == "3", F.substring("value", 1, 20)).otherwise(F.col("value")))
    good, _ = topics.parse_events(sent)
    return good.select("transaction_id", "vendor", F.col("amount").cast("double").alias("amount"))


def _register_topic(name: str, topic: str, event_type: str) -> None:
    @query(name, "WITH " + FEED_SQL + f"""
SELECT 'case-' || tx_id AS key, '{event_type}' AS event_type, cents / 100.0 AS amount FROM feed""")
    def _(spark: SparkSession, sf: str) -> DataFrame:
        df = feed(spark, sf).select(
            F.concat(F.lit("case-"), "tx_id").alias("case_id"), (F.col("cents") / 100.0).alias("amount"))
        out = topics.to_event(df, topic)
        return out.select("key", F.get_json_object("value", "$.event_type").alias("event_type"),
                          F.get_json_object("value", "$.amount").cast("double").alias("amount"))


for _args in (("anomaly_sink", "anomalies", "ANOMALY_DETECTED"), ("triage_sink", "triage", "TRIAGE_COMPLETE"),
              ("deep_audit_sink", "deep_audit", "DEEP_AUDIT_REQUESTED")):
    _register_topic(*_args)
