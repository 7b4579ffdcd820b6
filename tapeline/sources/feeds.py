"""Payloads other systems hand over: disclosures, filings, headlines, events,
quotes and reference data.  Each parser is a projection over many rows."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import plain_xml

# the reader travels with its function, so executors need no copy of this package
cloudpickle.register_pickle_by_value(plain_xml)

LAG_DAYS = 45
# fixed value: what counts as a purchase
BUY_PATTERN = "urchase|uy"


def _renamed(df: DataFrame) -> DataFrame:
    """Lower-cased trimmed headers with the two joined spellings split."""
    names = {"transactiondate": "transaction_date", "disclosuredate": "disclosure_date", "ticker": "symbol"}
    out = df
    for c in df.columns:
        low = c.strip().lower()
        out = out.withColumnRenamed(c, names.get(low, low))
    return out


def disclosures(raw: DataFrame, lag_days: int = LAG_DAYS) -> DataFrame:
    """Purchases only; a missing disclosure date is the trade date plus a lag."""
    df = _renamed(raw)
    late = (F.to_date("transaction_date") + F.expr(f"INTERVAL {lag_days} DAYS")).cast("timestamp")
    given = F.col("disclosure_date").cast("timestamp") if "disclosure_date" in df.columns else F.lit(None).cast("timestamp")
    kind = F.col("type").cast("string") if "type" in df.columns else F.lit("Purchase")
    return (
        df.withColumn("disclosure_date", F.coalesce(given, late))
        .withColumn("transaction_date", F.col("transaction_date").cast("timestamp"))
        .where(kind.rlike(BUY_PATTERN))
        .select(F.upper("symbol").alias("symbol") if "symbol" not in df.columns else F.col("symbol"), "transaction_date", "disclosure_date")
    )


def load_disclosures(spark, path: str) -> DataFrame:
    return disclosures(spark.read.option("header", True).csv(path))


_FORM4 = """reportingOwner STRUCT<
  reportingOwnerId: STRUCT<rptOwnerName: STRING>,
  reportingOwnerRelationship: STRUCT<isOfficer: STRING, isDirector: STRING, officerTitle: STRING>>,
nonDerivativeTable STRUCT<nonDerivativeTransaction: ARRAY<STRUCT<
  transactionCoding: STRUCT<transactionCode: STRING>,
  transactionAmounts: STRUCT<
    transactionShares: STRUCT<value: STRING>,
    transactionPricePerShare: STRUCT<value: STRING>,
    transactionAcquiredDisposedCode: STRUCT<value: STRING>>>>>"""


def _form4(xml: str) -> Column:
    """``from_xml``; documents of elements and text only are read by the batch."""
    schema = StructType.fromDDL(_FORM4)
    tree = plain_xml.tree_of(schema)
    return F.coalesce(F.arrow_udf(lambda x: plain_xml.read(x, tree), schema)(xml), F.from_xml(xml, _FORM4))


def parse_form4(filings: DataFrame, xml: str = "xml") -> DataFrame:
    """Transactions of Form 4 documents: one row per non-derivative line.

    The role is the officer title, else director, else officer, else insider;
    unreadable numbers count as 0."""
    keep = [c for c in filings.columns if c != xml]
    p = filings.withColumn("__f", _form4(xml))
    owner = F.col("__f.reportingOwner.reportingOwnerId.rptOwnerName")
    rel = F.col("__f.reportingOwner.reportingOwnerRelationship")
    title = F.trim(rel["officerTitle"])
    yes = lambda c: F.coalesce(c.isin("1", "true"), F.lit(False))
    role = (
        F.when(F.length(title) > 0, title)
        .when(yes(rel["isDirector"]), "Director")
        .when(yes(rel["isOfficer"]), "Officer")
        .otherwise("Insider")
    )
    p = p.select(
        *keep,
        F.coalesce(F.trim(owner), F.lit("insider")).alias("owner"),
        role.alias("role"),
        F.inline("__f.nonDerivativeTable.nonDerivativeTransaction"),
    )
    num = lambda c: F.coalesce(c.try_cast("double"), F.lit(0.0))
    sh, pr = num(F.col("transactionAmounts.transactionShares.value")), num(F.col("transactionAmounts.transactionPricePerShare.value"))
    return p.select(
        *keep,
        F.coalesce("transactionCoding.transactionCode", F.lit("")).alias("code"),
        sh.alias("shares"),
        pr.alias("price"),
        F.coalesce("transactionAmounts.transactionAcquiredDisposedCode.value", F.lit("")).alias("ad"),
        "owner",
        "role",
    )


def recent_filings(index: DataFrame, as_of: Column, days: int = 90, form: str = "4") -> DataFrame:
    """Rows of parallel arrays (form, accessionNumber, filingDate,
    primaryDocument); one form, dates inside the look-back, bad dates skipped."""
    z = F.arrays_zip("form", "accessionNumber", "filingDate", "primaryDocument")
    keep = [c for c in index.columns if c not in ("form", "accessionNumber", "filingDate", "primaryDocument")]
    x = index.select(*keep, as_of.alias("__t"), F.inline(z))
    day = F.try_to_date("filingDate", "yyyy-MM-dd")
    return x.where((F.col("form") == form) & (day >= F.date_sub(F.to_date("__t"), days))).select(
        *keep, F.regexp_replace("accessionNumber", "-", "").alias("accession"), day.alias("filing_date"), F.col("primaryDocument").alias("doc")
    )


_NEWS = """title STRING, publisher STRING, link STRING, providerPublishTime DOUBLE,
content STRUCT<title: STRING, pubDate: STRING, provider: STRUCT<displayName: STRING>, canonicalUrl: STRUCT<url: STRING>>"""


def headlines(items: DataFrame, as_of: Column, limit: int = 3, body: str = "json", order: str = "pos") -> DataFrame:
    """Headlines from two schema versions of one JSON feed: title (160
    characters), publisher, link and age, the first ``limit`` per symbol."""
    x = items.withColumn("__j", F.from_json(body, _NEWS))
    c, j = F.col("__j.content"), F.col("__j")
    hours = F.greatest(F.lit(0.0), (F.unix_timestamp(as_of) - j["providerPublishTime"]) / 3600.0)
    age = F.when(hours < 48, F.concat(F.format_string("%.0f", hours), F.lit("h ago"))).otherwise(
        F.concat(F.format_string("%.0f", hours / 24), F.lit("d ago"))
    )
    x = x.select(
        "symbol",
        order,
        F.substring(F.coalesce(c["title"], j["title"]), 1, 160).alias("title"),
        F.coalesce(c["provider"]["displayName"], j["publisher"]).alias("publisher"),
        F.coalesce(c["canonicalUrl"]["url"], j["link"]).alias("link"),
        F.coalesce(F.when(j["providerPublishTime"].isNotNull(), age), F.substring(c["pubDate"], 1, 10)).alias("when"),
    ).where(F.length("title") > 0)
    spec = Window.partitionBy("symbol").orderBy(order)
    return x.withColumn("rank", F.row_number().over(spec).cast("long")).where(F.col("rank") <= limit)


def next_event_date(events: DataFrame, as_of: Column, days: int = 120) -> DataFrame:
    """Earliest event date per symbol from ``as_of`` on, within ``days``."""
    d = F.to_date("event_ts")
    start = F.to_date(as_of)
    return (
        events.where((d >= start) & (d <= F.date_add(start, days)))
        .groupBy("symbol")
        .agg(F.min(d).cast("timestamp").alias("next_event"), F.datediff(F.min(d), F.min(start)).cast("long").alias("days_to_event"))
    )


def latest_quote(bars: DataFrame) -> DataFrame:
    """Last price, previous close, change and day range of every symbol."""
    x = bars.withColumn("__p", F.lag("close").over(Window.partitionBy("symbol").orderBy("ts")))
    g = x.groupBy("symbol").agg(F.max_by(F.struct("close", "__p", "high", "low", "ts"), "ts").alias("q"))
    return g.select(
        "symbol",
        F.col("q.close").alias("price"),
        F.col("q.__p").alias("prev_close"),
        (F.try_divide(F.col("q.close"), F.col("q.__p")) - 1.0).alias("change"),
        F.col("q.high").alias("day_high"),
        F.col("q.low").alias("day_low"),
        F.col("q.ts").alias("as_of"),
    )


def symbol_meta(symbols: DataFrame, info: DataFrame) -> DataFrame:
    """Display name (long, short, the symbol), currency and sector defaults."""
    return symbols.join(info, "symbol", "left").select(
        "symbol",
        F.coalesce("long_name", "short_name", "symbol").alias("name"),
        F.coalesce("currency", F.lit("USD")).alias("currency"),
        F.coalesce("sector", F.lit("")).alias("sector"),
    )


# fixed values: sector keys and their labels
SECTOR_LABELS = {
    "technology": "Technology",
    "financial_services": "Financial Services",
    "healthcare": "Healthcare",
    "consumer_cyclical": "Consumer Cyclical",
    "communication_services": "Communication Services",
    "industrials": "Industrials",
    "consumer_defensive": "Consumer Defensive",
    "energy": "Energy",
    "utilities": "Utilities",
    "realestate": "Real Estate",
    "basic_materials": "Basic Materials",
}


def norm_sector(c: Column) -> Column:
    """Label of a known key, title case of anything else, Other for blanks."""
    labels = F.create_map(*[F.lit(v) for kv in SECTOR_LABELS.items() for v in kv])
    blank = c.isNull() | (c == "")
    return F.when(blank, "Other").otherwise(F.coalesce(F.try_element_at(labels, c), F.initcap(c)))
