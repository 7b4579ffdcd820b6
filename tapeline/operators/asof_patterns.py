"""Chart patterns as they stood on past bars, from one table of validity intervals.

A swing is settled a few bars after it happened and stays in a chart of fixed
length for a known number of bars, so a pattern of swings is found once and
holds an interval of bars.  What depends on the chart's end, its price span,
enters as a bound on the pattern, tested where interval and sampled bar meet.
They meet by an equi-join on blocks of bars: an interval is shorter than a chart
and so lies in a few blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as w
from . import asof_events as A

ORDER = 5
#: Bars of a chart, and of a block of the interval join.
CHART, BLOCK = 260, 256


def swings(bars: DataFrame, k: int = ORDER) -> DataFrame:
    """``bars(symbol, i, close)`` in order of ``ts`` with ``kind`` of the strict extremum over +-k bars, NULL elsewhere."""
    left, right = w.ahead(-k, -1), w.ahead(1, k)
    full = (F.count("close").over(left) == k) & (F.count("close").over(right) == k)
    c = F.col("close")
    high = full & (c > F.max("close").over(left)) & (c > F.max("close").over(right))
    low = full & (c < F.min("close").over(left)) & (c < F.min("close").over(right))
    return bars.withColumn("kind", F.when(high, "high").when(low, "low"))


def reversal_intervals(marked: DataFrame, k: int = ORDER, chart: int = CHART) -> DataFrame:
    """One row per reversal that some chart may show.

    (symbol, rank, bias, lo, hi: first and last swing's bar; known, gone: first and last bar whose chart holds it; gap,
    slack: the chart's tolerance times ``slack`` must be ``gap`` or more; room: and less than this, where given)."""
    e = marked.where(F.col("kind").isNotNull()).select("symbol", "i", "kind", F.col("close").alias("price"))
    order = Window.partitionBy("symbol").orderBy("i")
    own = Window.partitionBy("symbol", "kind").orderBy("i")
    high = F.col("kind") == "high"
    # The swings of the other kind up to the next one of a kind share that kind's count.
    e = e.withColumns({"__h": F.count(F.when(high, 1)).over(order), "__l": F.count(F.when(~high, 1)).over(order)})
    e = e.withColumns(
        {
            "__low": F.min(F.when(~high, F.col("price"))).over(Window.partitionBy("symbol", "__h")),
            "__high": F.max(F.when(high, F.col("price"))).over(Window.partitionBy("symbol", "__l")),
            **{f"p{n}": F.lead("price", n).over(own) for n in (1, 2)},
            **{f"i{n}": F.lead("i", n).over(own) for n in (1, 2)},
        }
    )
    p, p1, p2 = F.col("price"), F.col("p1"), F.col("p2")

    def row(rank: int, bias: str, cond: Column, end: Column, gap: Column, slack: float, room: Column) -> Column:
        values = {"rank": F.lit(rank), "bias": F.lit(bias), "hi": end, "gap": gap, "slack": F.lit(slack), "room": room}
        return F.when(w.flag(cond), F.struct(*(v.alias(n) for n, v in values.items())))

    none = F.lit(None).cast("double")
    rows = [
        row(0, "bearish", high & p1.isNotNull() & F.col("__low").isNotNull(), F.col("i1"), F.abs(p - p1), 1.0, F.least(p, p1) - F.col("__low")),
        row(1, "bullish", ~high & p1.isNotNull() & F.col("__high").isNotNull(), F.col("i1"), F.abs(p - p1), 1.0, F.col("__high") - F.greatest(p, p1)),
        row(2, "bearish", high & (p1 > p) & (p1 > p2), F.col("i2"), F.abs(p - p2), 1.5, none),
        row(3, "bullish", ~high & (p1 < p) & (p1 < p2), F.col("i2"), F.abs(p - p2), 1.5, none),
    ]
    x = e.select("symbol", F.col("i").alias("lo"), F.inline(F.filter(F.array(*rows), lambda r: r.isNotNull())))
    # The first swing needs k bars of the chart before it, the last one k bars after it.
    x = x.withColumns({"known": F.col("hi") + k, "gone": F.col("lo") + (chart - 1 - k)})
    return x.where("known <= gone")


def reversals_asof(intervals: DataFrame, asked: DataFrame, limit: int = 5, block: int = BLOCK) -> DataFrame:
    """``asked(symbol, i, span)`` -> (symbol, i, found): the newest reversals of each bar's chart that do not overlap, newest first."""
    at = lambda c: F.floor(F.col(c) / block)
    held = intervals.withColumn("__b", F.explode(F.sequence(at("known"), at("gone"))))
    rows = asked.withColumn("__b", at("i")).join(held, ["symbol", "__b"])
    tol = F.when(F.col("span") == 0, F.lit(1.0)).otherwise(F.col("span")) * 0.03
    fits = (F.col("gap") <= tol * F.col("slack")) & (F.col("room").isNull() | (F.col("room") > tol))
    rows = rows.where(F.col("i").between(F.col("known"), F.col("gone")) & fits)
    # A chart of 260 bars has at most 43 swings of a kind, so this list is short.
    item = F.struct((-F.col("hi")).alias("o"), "rank", "lo", "hi", "bias")
    g = rows.groupBy("symbol", "i").agg(F.array_sort(F.collect_list(item)).alias("__all"))
    kind = rows.select(F.array(F.struct("lo", "hi", "bias")).alias("k")).schema["k"].dataType

    def step(kept: Column, p: Column) -> Column:
        # Newest first, so only the last one kept can be met.
        free = (F.size(kept) == 0) | (p["hi"] < F.element_at(kept, -1)["lo"])
        more = F.concat(kept, F.array(F.struct(p["lo"].alias("lo"), p["hi"].alias("hi"), p["bias"].alias("bias"))))
        return F.when(free & (F.size(kept) < limit), more).otherwise(kept)

    # element_at of an empty list is an error, so the first one starts the list.
    first = F.transform(F.slice("__all", 1, 1), lambda p: F.struct(p["lo"].alias("lo"), p["hi"].alias("hi"), p["bias"].alias("bias"))).cast(kind)
    rest = F.slice("__all", 2, 1_000_000)
    return g.select("symbol", "i", F.aggregate(rest, first, step).alias("found"))


def triangles_asof(marked: DataFrame, k: int = ORDER, chart: int = CHART) -> DataFrame:
    """Bars whose chart ends in a triangle: (symbol, i, bias, last), ``last`` the bar of its newest swing."""
    first = int(chart * 0.55)
    part = w.by().rowsBetween(-(chart - 1 - first), -k)
    price, x = F.col("close"), F.col("i").cast("double")
    high, low = F.col("kind") == "high", F.col("kind") == "low"
    mean = F.avg("close").over(w.trailing(chart - first))
    cells = {"__nh": F.count(F.when(high, 1)).over(part), "__nl": F.count(F.when(low, 1)).over(part)}
    for n, c in (("__sh", high), ("__sl", low)):
        cells[n] = F.regr_slope(F.when(c, price), F.when(c, x)).over(part)
    cells["last"] = F.max(F.when(F.col("kind").isNotNull(), F.col("i"))).over(part)
    t = marked.withColumns({**cells, "__m": mean})
    h, s, flat = w.ratio(F.col("__sh") * 100.0, "__m"), w.ratio(F.col("__sl") * 100.0, "__m"), 0.03
    bias = (
        F.when((F.abs(h) < flat) & (s > flat), "bullish").when((h < -flat) & (F.abs(s) < flat), "bearish").when((h < -flat) & (s > flat), "neutral")
    )
    return t.where((F.col("__nh") >= 3) & (F.col("__nl") >= 3)).withColumn("bias", bias).where(F.col("bias").isNotNull()).select("symbol", "i", "bias", "last")


def pattern_votes(bars: DataFrame, asked: DataFrame, k: int = ORDER, chart: int = CHART) -> DataFrame:
    """(symbol, i, patterns): a third of the votes of the three newest patterns in the chart that ends on bar i.

    ``bars(symbol, ts, i, close)``; ``asked(symbol, i)`` with i of a full chart.  Charts without a pattern have no row."""
    marked = swings(bars, k)
    span = w.roll(F.max, "close", chart) - w.roll(F.min, "close", chart)
    spans = bars.select("symbol", "i", span.alias("span")).join(asked.select("symbol", "i"), ["symbol", "i"], "left_semi")
    rev = reversals_asof(reversal_intervals(marked, k, chart), spans)
    tri = triangles_asof(marked, k, chart).select("symbol", "i", F.struct("last", "bias").alias("tri"))
    x = spans.join(rev, ["symbol", "i"], "left").join(tri, ["symbol", "i"], "left")
    # A triangle stands behind the reversals that end no earlier than it does.
    older = lambda p: p["hi"] < F.col("tri")["last"]
    bias = lambda a: F.transform(a, lambda p: p["bias"])
    found = F.coalesce("found", F.array().cast(rev.schema["found"].dataType))
    with_tri = F.concat(bias(F.filter(found, lambda p: ~older(p))), F.array(F.col("tri")["bias"]), bias(F.filter(found, older)))
    votes = F.transform(F.slice(F.when(F.col("tri").isNull(), bias(found)).otherwise(with_tri), 1, 3), A.bias_value)
    x = x.withColumn("__v", votes).where(F.size("__v") > 0)
    return x.select("symbol", "i", (F.aggregate("__v", F.lit(0.0), lambda a, b: a + b) / 3.0).alias("patterns"))
