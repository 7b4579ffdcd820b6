"""Payload parsing over text that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import insiders as IN
from ..sources import feeds as FD
from ..sources import positions as PO
from . import panels as P
from . import portfolio as PFP
from .registry import query

# fixed values: roles by supplier nation
ROLES = ["Chief Executive Officer", "", "", "CFO"]


def insider_rows(spark, d):
    li = P.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")
    part = P.table(spark, d, "part").select("p_partkey", "p_brand")
    s = P.table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return li.join(part, li["l_partkey"] == part["p_partkey"]).join(s, li["l_suppkey"] == s["s_suppkey"])


def filings(spark, d):
    """One Form 4 document per line: XML text built from the row."""
    x = insider_rows(spark, d)
    k = F.col("s_nationkey") % 4
    el = lambda name, c: F.concat(F.lit(f"<{name}>"), c.cast("string"), F.lit(f"</{name}>"))
    val = lambda name, c: el(name, el("value", c))
    title = F.when(k == 0, ROLES[0]).when(k == 3, ROLES[3]).otherwise("")
    owner = el("reportingOwner", F.concat(
        el("reportingOwnerId", el("rptOwnerName", F.col("s_name"))),
        el("reportingOwnerRelationship", F.concat(
            el("isDirector", F.when(k == 1, "1").otherwise("0")), el("isOfficer", F.when(k == 2, "true").otherwise("0")), el("officerTitle", title))),
    ))
    code = F.when(F.col("l_returnflag") == "A", "P").when(F.col("l_returnflag") == "R", "S").otherwise("M")
    tx = el("nonDerivativeTransaction", F.concat(
        el("transactionCoding", el("transactionCode", code)),
        el("transactionAmounts", F.concat(
            val("transactionShares", F.col("l_quantity")),
            val("transactionPricePerShare", F.when(F.col("l_linenumber") == 7, F.lit("n/a")).otherwise(F.col("l_extendedprice").cast("string"))),
            val("transactionAcquiredDisposedCode", F.when(F.col("l_returnflag") == "R", "D").otherwise("A")),
        )),
    ))
    xml = el("ownershipDocument", F.concat(owner, el("nonDerivativeTable", tx)))
    return x.select(F.col("p_brand").alias("issuer"), F.col("l_shipdate").cast("timestamp").alias("ts"), xml.alias("xml"))


_ROLE = "CASE s_nationkey % 4 WHEN 0 THEN 'Chief Executive Officer' WHEN 1 THEN 'Director' WHEN 2 THEN 'Officer' ELSE 'CFO' END"
TX = f"""tx AS MATERIALIZED (SELECT p_brand AS issuer, l_shipdate AS ts, CASE l_returnflag WHEN 'A' THEN 'P' WHEN 'R' THEN 'S' ELSE 'M' END AS code, l_quantity AS shares,
 CASE WHEN l_linenumber = 7 THEN 0.0 ELSE l_extendedprice END AS price, CASE l_returnflag WHEN 'R' THEN 'D' ELSE 'A' END AS ad, s_name AS owner, {_ROLE} AS role
 FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""


@query("parse_form4", "A13 K15", P.with_(TX) + "SELECT * FROM tx")
def parse_form4(spark, d):
    return FD.parse_form4(filings(spark, d))


@query(
    "insider_summary",
    "E22 K2",
    P.with_(
        TX,
        "mx AS (SELECT max(ts) AS t FROM tx)",
        "rc AS MATERIALIZED (SELECT tx.* FROM tx, mx WHERE ts >= t - INTERVAL 90 DAY)",
        "sd AS (SELECT issuer, "
        + ", ".join(
            f"count(*) FILTER (code = '{c}') AS n_{n}, count(DISTINCT owner) FILTER (code = '{c}') AS {n}_people, coalesce(sum(shares) FILTER (code = '{c}'), 0) AS {n}_shares, coalesce(sum(shares * price) FILTER (code = '{c}'), 0) AS {n}_value, "
            f"avg(price) FILTER (code = '{c}' AND price > 0) AS {n}_avg_price, coalesce(bool_or(role IN ('Chief Executive Officer', 'CFO')) FILTER (code = '{c}'), false) AS {n}_csuite"
            for c, n in (("P", "buy"), ("S", "sell"))
        )
        + ", count(*) FILTER (code = 'M') AS n_routine FROM rc GROUP BY 1)",
        "pp AS (SELECT issuer, string_agg(owner, ',' ORDER BY owner) AS people FROM (SELECT DISTINCT issuer, owner FROM rc WHERE code = 'P') WHERE true GROUP BY 1)",
        "p6 AS (SELECT issuer, string_agg(owner, ',' ORDER BY owner) AS buy_names FROM (SELECT issuer, owner, row_number() OVER (PARTITION BY issuer ORDER BY owner) AS k FROM (SELECT DISTINCT issuer, owner FROM rc WHERE code = 'P')) WHERE k <= 6 GROUP BY 1)",
        "sw AS (SELECT *, CASE WHEN buy_value > 0 THEN buy_value ELSE buy_shares END AS bw, CASE WHEN sell_value > 0 THEN sell_value ELSE sell_shares END AS sw FROM sd)",
    )
    + "SELECT sw.* EXCLUDE (bw, sw), buy_names, buy_people >= 3 AND buy_shares > 0 AS cluster_buy, CASE WHEN bw > 0 AND bw >= sw THEN 'buying' WHEN sw > 0 AND sw > bw THEN 'selling' ELSE 'routine' END AS signal FROM sw LEFT JOIN p6 USING (issuer)",
)
def insider_summary(spark, d):
    return IN.summary(FD.parse_form4(IN.recent(filings(spark, d), 90)))


@query(
    "recent_filings",
    "A14 K14",
    """WITH f AS (SELECT *, max(l_shipdate) OVER () AS t FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT p_brand AS issuer, replace(l_orderkey || '-' || l_linenumber, '-', '') AS accession, CAST(l_shipdate AS DATE) AS filing_date, 'doc' || l_partkey AS doc FROM f WHERE l_linenumber % 2 = 0 AND l_linenumber <> 6 AND l_shipdate >= CAST(CAST(t AS DATE) - 90 AS TIMESTAMP)""",
)
def recent_filings(spark, d):
    """Parallel arrays per order line group, exploded and filtered; line 6 has an
    unreadable date."""
    li = P.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    part = P.table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("issuer"))
    x = li.join(part, li["l_partkey"] == part["p_partkey"])
    day = F.when(F.col("l_linenumber") == 6, F.lit("not a date")).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    row = F.struct(
        F.when(F.col("l_linenumber") % 2 == 0, "4").otherwise("10-K").alias("form"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("accessionNumber"),
        day.alias("filingDate"),
        F.concat(F.lit("doc"), F.col("l_partkey")).alias("primaryDocument"),
    )
    # a feed of several filings: one array set per order and issuer
    g = x.groupBy("issuer", "l_orderkey").agg(F.collect_list(row).alias("r"))
    idx = g.select("issuer", *[F.col("r")[c].alias(c) for c in ("form", "accessionNumber", "filingDate", "primaryDocument")])
    newest = li.agg(F.max("l_shipdate").cast("timestamp")).scalar()
    return FD.recent_filings(idx, newest).select("issuer", "accession", "filing_date", "doc")


@query(
    "normalize_headlines",
    "A16 K15",
    """WITH e AS (SELECT *, max(ts) OVER () AS t, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events WHERE event_id % 7 <> 0)
SELECT event_type AS symbol, event_id AS pos, left('Event ' || event_id || ' by user ' || user_id || repeat('.', 160), 160) AS title, CASE WHEN event_id % 2 = 0 THEN 'new wire' ELSE 'old wire' END AS publisher, 'http://x/' || event_id AS link,
 CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d') ELSE printf('%.0f', (epoch(t) // 1 - epoch(ts) // 1) / 3600.0 / 24) || 'd ago' END AS "when", k AS rank FROM e WHERE k <= 3""",
)
def normalize_headlines(spark, d):
    ev = P.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    title = F.concat(F.lit("Event "), F.col("event_id"), F.lit(" by user "), F.col("user_id"), F.repeat(F.lit("."), 160))
    title = F.when(F.col("event_id") % 7 != 0, title)
    link = F.concat(F.lit("http://x/"), F.col("event_id"))
    new = F.to_json(F.struct(F.struct(
        title.alias("title"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm").alias("pubDate"), F.struct(F.lit("new wire").alias("displayName")).alias("provider"), F.struct(link.alias("url")).alias("canonicalUrl")
    ).alias("content")))
    old = F.to_json(F.struct(title.alias("title"), F.lit("old wire").alias("publisher"), link.alias("link"), F.unix_timestamp("ts").alias("providerPublishTime")))
    newest = ev.agg(F.max("ts")).scalar()
    items = ev.select("event_type", "event_id", F.when(F.col("event_id") % 2 == 0, new).otherwise(old).alias("json"))
    return FD.headlines(items.select(F.col("event_type").alias("symbol"), F.col("event_id").alias("pos"), "json"), newest)


@query(
    "next_event_date",
    "A17 K12",
    """SELECT p_brand AS symbol, CAST(min(CAST(l_shipdate AS DATE)) AS TIMESTAMP) AS next_event, date_diff('day', DATE '1999-06-01', min(CAST(l_shipdate AS DATE))) AS days_to_event
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1999-06-01' AND l_shipdate <= CAST(DATE '1999-06-01' + 120 AS TIMESTAMP) GROUP BY 1""",
)
def next_event_date(spark, d):
    return FD.next_event_date(events(spark, d), F.lit("1999-06-01").cast("timestamp"))


def events(spark, d):
    """Calendar events: every line item is an event of its brand on the day it ships."""
    li = P.table(spark, d, "lineitem").select("l_partkey", "l_shipdate")
    part = P.table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    return li.join(part, li["l_partkey"] == part["p_partkey"]).select("symbol", F.col("l_shipdate").cast("timestamp").alias("event_ts"))


@query(
    "latest_quote",
    "A18",
    P.with_(P.bars_sql("brand"))
    + "SELECT symbol, close AS price, p AS prev_close, close / p - 1 AS change, high AS day_high, low AS day_low, ts AS as_of FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS p, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM bars) WHERE k = 1",
)
def latest_quote(spark, d):
    return FD.latest_quote(P.brand_bars(spark, d))


@query(
    "symbol_meta",
    "A19 J5",
    """SELECT n_name AS symbol, coalesce(CASE WHEN n_nationkey % 3 = 0 THEN 'The ' || n_name END, CASE WHEN n_nationkey % 3 = 1 THEN lower(n_name) END, n_name) AS name,
 CASE WHEN n_nationkey % 2 = 0 THEN 'EUR' ELSE 'USD' END AS currency, CASE WHEN n_nationkey < 20 THEN r_name ELSE '' END AS sector FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
def symbol_meta(spark, d):
    n = P.nations(spark, d)
    k = F.col("n_nationkey")
    info = n.where(k < 20).select(
        "symbol",
        F.when(k % 3 == 0, F.concat(F.lit("The "), F.col("symbol"))).alias("long_name"),
        F.when(k % 3 == 1, F.lower("symbol")).alias("short_name"),
        F.when(k % 2 == 0, "EUR").alias("currency"),
        "sector",
    )
    rest = n.where(k >= 20).select(
        "symbol",
        F.when(k % 3 == 0, F.concat(F.lit("The "), F.col("symbol"))).alias("long_name"),
        F.when(k % 3 == 1, F.lower("symbol")).alias("short_name"),
        F.when(k % 2 == 0, "EUR").alias("currency"),
        F.lit(None).cast("string").alias("sector"),
    )
    return FD.symbol_meta(n.select("symbol"), info.unionByName(rest))


@query("load_disclosures", "A15", "SELECT p_brand AS symbol, l_shipdate AS transaction_date, CAST(l_shipdate + INTERVAL 45 DAY AS TIMESTAMP) AS disclosure_date FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'A'")
def load_disclosures(spark, d):
    from .evaluations import purchases

    return purchases(spark, d)


def _export(spark, d):
    """Lines of broker exports, one file per account: a title, a header whose
    wording and column order vary by account, quoted cells, cash and total rows."""
    h = PFP.holdings(spark, d)
    odd = F.pmod(F.length("account"), F.lit(2)) == 1
    name = F.translate("symbol", "#0123456789", "-ABCDEFGHIJ")
    money = lambda c: F.concat(F.lit('"$'), F.format_number(c, 2), F.lit('"'))
    row = F.when(odd, F.concat_ws(",", F.concat(F.lit('"'), name, F.lit('"')), F.lit("lot"), F.col("shares").cast("string"), money(F.col("avg_cost")))).otherwise(
        F.concat_ws(",", F.col("shares").cast("string"), money(F.col("avg_cost") * F.col("shares")), name)
    )
    body = h.select("account", F.concat(F.lit("b"), F.col("symbol")).alias("o"), row.alias("line"))
    acc = h.select("account").distinct()
    head = F.when(odd, F.lit("Symbol,Description,Quantity,Average Cost")).otherwise(F.lit("Shares,Cost Basis,Instrument Name"))
    tot = F.when(odd, F.lit("Cash,,0,")).otherwise(F.lit('0,"$1.00",Total'))
    extra = acc.select("account", F.explode(F.array(
        F.struct(F.lit("a0").alias("o"), F.lit("Positions export").alias("line")), F.struct(F.lit("a1").alias("o"), head.alias("line")), F.struct(F.lit("z").alias("o"), tot.alias("line"))
    )).alias("x")).select("account", "x.*")
    return body.unionByName(extra).select("account", F.col("o").alias("line_no"), "line")


@query(
    "import_positions_csv",
    "A11",
    P.with_(*PFP.HOLD)
    + "SELECT account, translate(symbol, '#0123456789', '-ABCDEFGHIJ') AS s0, shares, avg_cost FROM hd".replace("translate(symbol, '#0123456789', '-ABCDEFGHIJ') AS s0", "upper(translate(symbol, '#0123456789', '-ABCDEFGHIJ')) AS symbol").replace("avg_cost FROM", "CASE WHEN length(account) % 2 = 1 THEN round(avg_cost, 2) ELSE round(round(avg_cost * shares, 2) / shares, 2) END AS avg_cost FROM"),
)
def import_positions_csv(spark, d):
    return PO.positions_from_lines(_export(spark, d))


def _books(spark, d):
    h = PFP.holdings(spark, d)
    a = PFP.accounts(spark, d)
    g = h.groupBy("account").agg(F.array_sort(F.collect_list(F.struct(F.lower("symbol").alias("ticker"), "shares", "avg_cost"))).alias("holdings"))
    return g.join(a, "account").select(F.to_json(F.struct("account", "cash", F.array(F.lit("Brand#1")).alias("watchlist"), "holdings")).alias("json"))


@query("read_holdings_json", "A10", P.with_(*PFP.HOLD) + "SELECT account, upper(symbol) AS symbol, shares, avg_cost, cash FROM hd JOIN ac USING (account)")
def read_holdings_json(spark, d):
    b = PO.books_from_json(_books(spark, d))
    return PO.holdings_of(b).join(PO.cash_of(b), "account")


@query(
    "validate_holdings",
    "A12 K11",
    """SELECT account, symbol, CASE WHEN error IS NULL THEN shares END AS shares, CASE WHEN error IS NULL THEN price END AS avg_cost, error FROM (
 SELECT CAST(l_orderkey AS VARCHAR) AS account, CAST(l_partkey AS VARCHAR) AS symbol, l_quantity AS shares, l_extendedprice AS price,
 CASE WHEN l_linenumber = 1 THEN 'shares is invalid' WHEN l_linenumber = 2 THEN 'shares is non-finite' WHEN l_linenumber = 3 THEN 'shares is negative' WHEN l_linenumber = 4 THEN 'avg_cost is non-finite' WHEN l_linenumber = 5 THEN 'missing shares' END AS error FROM lineitem)""",
)
def validate_holdings(spark, d):
    n = F.col("l_linenumber")
    q = F.col("l_quantity").cast("string")
    sh = F.when(n == 1, "ten").when(n == 2, "NaN").when(n == 3, F.concat(F.lit("-"), q)).when(n == 5, F.lit(None).cast("string")).otherwise(q)
    co = F.when(n == 4, "Infinity").otherwise(F.col("l_extendedprice").cast("string"))
    raw = P.table(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("account"), F.col("l_partkey").cast("string").alias("symbol"), sh.alias("shares"), co.alias("avg_cost")
    )
    return PO.validate_holdings(raw)


@query(
    "scan_universe",
    "K10 E16",
    P.with_(*PFP.HOLD)
    + "SELECT symbol, min(origin) AS origin FROM (SELECT symbol, 0::BIGINT AS origin FROM hd UNION ALL SELECT p_brand, 1 FROM part UNION ALL SELECT 'EXTRA', 2) WHERE symbol NOT IN (SELECT fund FROM fh) GROUP BY 1",
)
def scan_universe(spark, d):
    watch = P.table(spark, d, "part").select(F.col("p_brand").alias("symbol"))
    extra = spark.createDataFrame([("EXTRA",)], "symbol string")
    return PO.universe(PFP.holdings(spark, d), watch, extra, PFP.fund_holdings(spark, d))
