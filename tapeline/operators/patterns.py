"""Swing extrema, support / resistance clusters and chart patterns.

A strict extremum over +-k bars already keeps same-kind extrema more than k
bars apart, so no thinning pass is needed.  Neighbour logic runs on the small
extrema table with ``lag``/``lead``; only the clusters and the interval
exclusion are folds, over one symbol's extrema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import session
from ..functions import windows as w

ORDER = 5


def chart_tail(df: DataFrame, bars: int | None = None) -> DataFrame:
    """Bars with their ordinal ``x`` and the length ``n``: the whole frame, or
    the newest ``bars`` of it where the caller asks for a chart window."""
    d = df if bars is None else df.withColumn("__a", w.bars_ago()).where(F.col("__a") < bars).drop("__a")
    return session.keep(d.withColumns({"x": w.bar_no(), "n": w.n_bars()}))


def swing_extrema(df: DataFrame, k: int = ORDER) -> DataFrame:
    """(symbol, ts, x, n, kind, price): interior strict extrema of the close."""
    left, right = w.ahead(-k, -1), w.ahead(1, k)
    full = (F.count("close").over(left) == k) & (F.count("close").over(right) == k)
    c = F.col("close")
    x = df.withColumn(
        "kind",
        F.when(full & (c > F.max("close").over(left)) & (c > F.max("close").over(right)), "high").when(
            full & (c < F.min("close").over(left)) & (c < F.min("close").over(right)), "low"
        ),
    )
    return x.where(F.col("kind").isNotNull()).select("symbol", "ts", "x", "n", "kind", c.alias("price"))


def support_resistance(df: DataFrame, k: int = ORDER, max_levels: int = 4, bars: int | None = None) -> DataFrame:
    """Swing prices clustered within 2% of the chart's span (a price joins the
    last cluster when near its running mean), split by the newest close and
    numbered from the nearest."""
    d = chart_tail(df, bars)
    head = d.groupBy("symbol").agg(
        F.max_by("close", "ts").alias("price"), (F.max("close") - F.min("close")).alias("span")
    )
    swings = swing_extrema(d, k).groupBy("symbol").agg(F.array_sort(F.collect_list("price")).alias("ps"))
    x = head.join(swings, "symbol")
    tol = F.when(F.col("span") == 0, F.lit(1.0)).otherwise(F.col("span")) * 0.02
    x = x.withColumn("tol", tol)
    kind = "array<struct<s:double,c:bigint>>"

    def step(acc: Column, p: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        near = F.coalesce(F.abs(p - last["s"] / last["c"]) <= F.col("tol"), F.lit(False))
        grown = F.struct((last["s"] + p).alias("s"), (last["c"] + 1).alias("c"))
        fresh = F.struct(p.alias("s"), F.lit(1).cast("long").alias("c"))
        return F.when(near, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))).otherwise(
            F.concat(acc, F.array(fresh))
        )

    x = x.withColumn("cl", F.aggregate("ps", F.array().cast(kind), step))
    lv = x.select("symbol", "price", F.inline("cl")).withColumn("level", F.col("s") / F.col("c"))
    lv = lv.withColumn("kind", F.when(F.col("level") > F.col("price"), "resistance").when(F.col("level") < F.col("price"), "support"))
    near = Window.partitionBy("symbol", "kind").orderBy(F.abs(F.col("level") - F.col("price")), "level")
    return (
        lv.where(F.col("kind").isNotNull())
        .withColumn("pos", F.row_number().over(near).cast("long"))
        .where(F.col("pos") <= max_levels)
        .select("symbol", "kind", "pos", "level", F.col("c").alias("touches"))
    )


def _reversals(ext: DataFrame, tol: Column) -> DataFrame:
    """Double tops and bottoms, head and shoulders and their inverses."""
    e = ext.withColumn("tol", tol)
    own = Window.partitionBy("symbol", "kind").orderBy("x")
    order = Window.partitionBy("symbol").orderBy("x")
    # the opposite extreme between this extremum and the next of its kind:
    # number the runs by the same-kind count, then take the best of each run
    e = e.withColumns(
        {
            "__h": F.count(F.when(F.col("kind") == "high", 1)).over(order),
            "__l": F.count(F.when(F.col("kind") == "low", 1)).over(order),
        }
    )
    after_high = Window.partitionBy("symbol", "__h")
    after_low = Window.partitionBy("symbol", "__l")
    low = F.when(F.col("kind") == "low", F.col("price"))
    high = F.when(F.col("kind") == "high", F.col("price"))
    e = e.withColumns(
        {
            "__trough": F.min(low).over(after_high),
            "__trough_ts": F.min_by(F.when(F.col("kind") == "low", F.col("ts")), F.when(F.col("kind") == "low", F.struct("price", "x"))).over(after_high),
            "__peak": F.max(high).over(after_low),
            "__peak_ts": F.max_by(F.when(F.col("kind") == "high", F.col("ts")), F.when(F.col("kind") == "high", F.struct(F.col("price"), -F.col("x")))).over(after_low),
        }
    )
    for n in (1, 2):
        e = e.withColumns({f"p{n}": F.lead("price", n).over(own), f"t{n}": F.lead("ts", n).over(own)})
    p, p1, p2, t = F.col("price"), F.col("p1"), F.col("p2"), F.col("tol")
    is_high, is_low = F.col("kind") == "high", F.col("kind") == "low"
    near = F.abs(p - p1) <= t
    shoulders = F.abs(p - p2) <= 1.5 * t

    def row(rank: int, name: str, bias: str, cond: Column, mid: Column, mid_p: Column, end: Column, end_p: Column) -> Column:
        pt = lambda ts, v: F.struct(ts.alias("ts"), v.alias("price"))
        return F.when(
            w.flag(cond),
            F.struct(
                F.lit(rank).alias("rank"),
                F.lit(name).alias("name"),
                F.lit(bias).alias("bias"),
                F.array(pt(F.col("ts"), p), pt(mid, mid_p), pt(end, end_p)).alias("points"),
            ),
        )

    # fixed values: pattern names and biases
    rows = [
        row(0, "Double Top", "bearish", is_high & near & (F.col("__trough") < F.least(p, p1) - t), F.col("__trough_ts"), F.col("__trough"), F.col("t1"), p1),
        row(1, "Double Bottom", "bullish", is_low & near & (F.col("__peak") > F.greatest(p, p1) + t), F.col("__peak_ts"), F.col("__peak"), F.col("t1"), p1),
        row(2, "Head & Shoulders", "bearish", is_high & (p1 > p) & (p1 > p2) & shoulders, F.col("t1"), p1, F.col("t2"), p2),
        row(3, "Inverse Head & Shoulders", "bullish", is_low & (p1 < p) & (p1 < p2) & shoulders, F.col("t1"), p1, F.col("t2"), p2),
    ]
    return e.select("symbol", "x", F.inline(F.filter(F.array(*rows), lambda r: r.isNotNull())))


def reversals(df: DataFrame, k: int = ORDER, bars: int | None = None) -> DataFrame:
    """Every reversal of the chart before de-overlap."""
    d = chart_tail(df, bars)
    d = d.withColumn("__span", F.max("close").over(w.whole()) - F.min("close").over(w.whole()))
    ext = swing_extrema(d, k)
    span = d.groupBy("symbol").agg(F.max("__span").alias("__span"))
    ext = ext.join(span, "symbol")
    tol = F.when(F.col("__span") == 0, F.lit(1.0)).otherwise(F.col("__span")) * 0.03
    r = _reversals(ext, tol)
    return r.withColumns({"lo": F.col("points")[0]["ts"], "hi": F.col("points")[2]["ts"]})


def triangles(df: DataFrame, k: int = ORDER, bars: int | None = None) -> DataFrame:
    """Ascending, descending and symmetrical triangles from the slopes of the
    swing highs and lows in the last 45% of the chart."""
    d = chart_tail(df, bars)
    cut = F.floor(F.col("n") * 0.55)
    mean = d.where(F.col("x") >= cut).groupBy("symbol").agg(F.avg("close").alias("__m"))
    e = swing_extrema(d, k).where(F.col("x") >= cut)
    xs = F.col("x").cast("double")
    hi, lo = F.col("kind") == "high", F.col("kind") == "low"
    g = e.groupBy("symbol").agg(
        F.count(F.when(hi, 1)).alias("highs"),
        F.count(F.when(lo, 1)).alias("lows"),
        F.regr_slope(F.when(hi, F.col("price")), F.when(hi, xs)).alias("__sh"),
        F.regr_slope(F.when(lo, F.col("price")), F.when(lo, xs)).alias("__sl"),
        F.min_by(F.struct("ts", "price"), "x").alias("__p0"),
        F.max_by(F.struct("ts", "price"), "x").alias("__p1"),
    ).join(mean, "symbol")
    g = g.withColumns({"slope_high": w.ratio(F.col("__sh") * 100.0, "__m"), "slope_low": w.ratio(F.col("__sl") * 100.0, "__m")})
    h, l, flat = F.col("slope_high"), F.col("slope_low"), 0.03
    name = (
        F.when((F.abs(h) < flat) & (l > flat), "Ascending Triangle")
        .when((h < -flat) & (F.abs(l) < flat), "Descending Triangle")
        .when((h < -flat) & (l > flat), "Symmetrical Triangle")
    )
    bias = F.when(F.col("name") == "Ascending Triangle", "bullish").when(F.col("name") == "Descending Triangle", "bearish").otherwise("neutral")
    return (
        g.where((F.col("highs") >= 3) & (F.col("lows") >= 3))
        .withColumn("name", name)
        .where(F.col("name").isNotNull())
        .withColumn("bias", bias)
        .select("symbol", "name", "bias", "slope_high", "slope_low", F.array("__p0", "__p1").alias("points"))
    )


def drop_overlaps(found: DataFrame, limit: int = 5) -> DataFrame:
    """Newest first, skip a pattern whose span meets one already kept."""
    item = F.struct((-F.unix_micros("hi")).alias("o"), "rank", "x", "name", "bias", "points", "lo", "hi")
    e = found.groupBy("symbol").agg(F.array_sort(F.collect_list(item)).alias("__e"))
    kind = found.select(F.array(item).alias("k")).schema["k"].dataType

    def step(acc: Column, p: Column) -> Column:
        clash = F.exists(acc, lambda q: ~((p["hi"] < q["lo"]) | (p["lo"] > q["hi"])))
        return F.when(clash, acc).otherwise(F.concat(acc, F.array(p)))

    kept = F.slice(F.aggregate("__e", F.array().cast(kind), step), 1, limit)
    return e.select("symbol", F.inline(kept)).drop("o")


def chart_patterns(df: DataFrame, k: int = ORDER, bars: int | None = None, limit: int = 6) -> DataFrame:
    """De-overlapped reversals and triangles, newest ``limit`` per symbol."""
    rev = drop_overlaps(reversals(df, k, bars)).select("symbol", "rank", "x", "name", "bias", "points", "hi")
    tri = triangles(df, k, bars).select(
        "symbol", F.lit(9).alias("rank"), F.lit(0).cast("long").alias("x"), "name", "bias", "points", F.col("points")[1]["ts"].alias("hi")
    )
    both = rev.unionByName(tri)
    spec = Window.partitionBy("symbol").orderBy(F.desc("hi"), "rank", "x")
    return (
        both.withColumn("pos", F.row_number().over(spec).cast("long"))
        .where(F.col("pos") <= limit)
        .select("symbol", "pos", "name", "bias", "points", F.col("points")[0]["ts"].alias("start_ts"), F.col("hi").alias("end_ts"))
    )


def staleness(patterns: DataFrame, latest: DataFrame, stale_bars: int = 21) -> DataFrame:
    """Age in days of each pattern's last point and whether it is stale."""
    age = F.datediff("now", "end_ts")
    now = latest.groupBy("symbol").agg(F.max("ts").alias("now"))
    return patterns.join(now, "symbol").select(
        "symbol", "pos", "name", "bias", age.cast("long").alias("age_days"), (age > stale_bars * 1.5).alias("stale")
    )
