"""Holdings: JSON books, broker CSV exports and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BOOK = """account STRING, cash DOUBLE, watchlist ARRAY<STRING>,
holdings ARRAY<STRUCT<ticker: STRING, shares: DOUBLE, avg_cost: DOUBLE>>"""


def books_from_json(docs: DataFrame, body: str = "json") -> DataFrame:
    return docs.select(F.from_json(body, _BOOK).alias("b")).select("b.*")


def read_books(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_BOOK).option("multiLine", True).json(path)


def holdings_of(books: DataFrame) -> DataFrame:
    return books.select("account", F.inline("holdings")).select(
        "account", F.upper(F.trim("ticker")).alias("symbol"), "shares", "avg_cost"
    )


def cash_of(books: DataFrame) -> DataFrame:
    return books.select("account", F.coalesce("cash", F.lit(0.0)).alias("cash"))


def watchlist_of(books: DataFrame) -> DataFrame:
    return books.select("account", F.explode("watchlist").alias("symbol"))


# fixed values: header words of broker exports
SYMBOL_WORDS = ["symbol", "ticker", "instrument"]
QTY_WORDS = ["quantity", "shares", "qty"]
COST_WORDS = ["average cost", "avg cost", "average buy", "avg price", "average price", "cost/share", "cost per share"]
BASIS_WORDS = ["cost basis", "total cost"]
_CELL = r'(?:^|,)("(?:[^"]|"")*"|[^,]*)'


def _cells(line: Column) -> Column:
    """Cells of one CSV line, quotes removed and doubled quotes undone."""
    raw = F.regexp_extract_all(line, F.lit(_CELL), F.lit(1))
    return F.transform(
        raw,
        lambda c: F.when(c.startswith('"'), F.regexp_replace(F.regexp_replace(c, r'^"|"$', ""), '""', '"')).otherwise(c),
    )


def _has(cells: Column, words: list[str], exact: str | None = None) -> Column:
    def hit(c: Column) -> Column:
        cond = F.lit(False)
        for word in words:
            cond = cond | (c == word if word == exact else c.contains(word))
        return cond

    return F.exists(cells, hit)


def _find(cells: Column, words: list[str]) -> Column:
    """1-based position of the first cell containing any word, 0 if none."""
    flags = F.transform(cells, lambda c: F.array_contains(F.transform(F.array(*[F.lit(x) for x in words]), lambda x: c.contains(x)), True))
    return F.coalesce(F.array_position(flags, True), F.lit(0)).cast("int")


def _number(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[^0-9.\-]", "").try_cast("double")


def _at(cells: Column, pos: Column) -> Column:
    return F.when(pos > 0, F.get(cells, pos - 1))


def positions_from_lines(lines: DataFrame) -> DataFrame:
    """Positions of many broker exports at once.

    ``lines`` holds (account, line_no, line).  Per account the first line with a
    symbol-like and a quantity-like cell is the header; it is found by one small
    aggregation and joined back, so an export is never gathered in one task.
    Columns are matched by name, a total cost is divided by the shares, cash and
    total rows fall out, and duplicate symbols merge by share-weighted cost."""
    x = lines.where(F.length(F.trim("line")) > 0).withColumn("cells", _cells(F.col("line")))
    low = F.transform("cells", lambda c: F.lower(F.trim(c)))
    head = x.withColumn("low", low).where(_has(F.col("low"), SYMBOL_WORDS) & _has(F.col("low"), QTY_WORDS, exact="qty"))
    head = head.groupBy("account").agg(F.min_by(F.struct("line_no", "low"), "line_no").alias("h"))
    head = head.select(
        "account",
        F.col("h.line_no").alias("head_no"),
        _find(F.col("h.low"), SYMBOL_WORDS).alias("ti"),
        _find(F.col("h.low"), QTY_WORDS).alias("qi"),
        _find(F.col("h.low"), COST_WORDS).alias("ci"),
        _find(F.col("h.low"), BASIS_WORDS).alias("bi"),
    )
    r = x.join(head, "account").where(F.col("line_no") > F.col("head_no"))
    cells = F.col("cells")
    symbol = F.regexp_replace(F.upper(F.trim(F.coalesce(_at(cells, F.col("ti")), F.lit("")))), r"[^A-Z.\-]", "")
    r = r.select("account", "line_no", symbol.alias("symbol"), _number(_at(cells, F.col("qi"))).alias("shares"), _number(_at(cells, F.col("ci"))).alias("cost"), _number(_at(cells, F.col("bi"))).alias("basis"))
    r = r.where((F.col("symbol") != "") & (F.col("shares") > 0))
    r = r.withColumn("cost", F.coalesce("cost", F.col("basis") / F.col("shares")))
    known = F.col("cost").isNotNull()
    g = r.groupBy("account", "symbol").agg(
        F.sum("shares").alias("shares"),
        F.sum(F.when(known, F.col("cost") * F.col("shares"))).alias("__v"),
        F.sum(F.when(known, F.col("shares"))).alias("__s"),
    )
    return g.select(
        "account", "symbol", F.round("shares", 6).alias("shares"), F.round(F.try_divide("__v", "__s"), 2).alias("avg_cost")
    )


def numbered_lines(docs: DataFrame, body: str = "text") -> DataFrame:
    """(account, line_no, line) of whole documents, split inside each row."""
    parts = F.split(body, r"\r?\n")
    return docs.select("account", F.posexplode(parts).alias("line_no", "line"))


def validate_holdings(raw: DataFrame) -> DataFrame:
    """Coerced numbers with an ``error`` column: numeric text is accepted; NULL,
    NaN, infinite or negative shares or costs are not; negative cash is."""
    sh, co = F.col("shares").cast("string").try_cast("double"), F.col("avg_cost").cast("string").try_cast("double")
    bad = lambda v: F.isnan(v) | (F.abs(v) == float("inf"))
    error = (
        F.when(F.col("symbol").isNull() | (F.trim("symbol") == ""), "missing ticker")
        .when(F.col("shares").isNull(), "missing shares")
        .when(sh.isNull(), "shares is invalid")
        .when(bad(sh), "shares is non-finite")
        .when(sh < 0, "shares is negative")
        .when(F.col("avg_cost").isNotNull() & co.isNull(), "avg_cost is invalid")
        .when(bad(co), "avg_cost is non-finite")
        .when(co < 0, "avg_cost is negative")
    )
    ok = error.isNull()
    return raw.select(
        "account", "symbol", F.when(ok, sh).alias("shares"), F.when(ok, co).alias("avg_cost"), error.alias("error")
    )


def universe(holdings: DataFrame, watchlist: DataFrame, extra: DataFrame, funds: DataFrame) -> DataFrame:
    """Symbols to scan: holdings, then watch list, then extras, each once (its
    first origin kept) and without funds."""
    u = (
        holdings.select("symbol", F.lit(0).alias("origin"))
        .unionByName(watchlist.select("symbol", F.lit(1).alias("origin")))
        .unionByName(extra.select("symbol", F.lit(2).alias("origin")))
    )
    u = u.groupBy("symbol").agg(F.min("origin").cast("long").alias("origin"))
    return u.join(funds.select(F.col("fund").alias("symbol")).distinct(), "symbol", "left_anti")
