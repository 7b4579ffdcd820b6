"""Price levels: prior highs, confirmed pivots, clusters and volume shelves.

Frames are bounded by their look-back, so nothing here grows with history
except ``nearest_pivot_above``, which meets pivots through price bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as w
from . import indicators as I
from . import joins
from . import regimes as R

LOOKBACK = 50
PIVOT = 3
TOL = 0.015
NEAR = 0.02
HOLD = 21

# fixed values: distance to the old high, measured reach rates and counts
ATH_BY_DISTANCE = [
    (-9.0, 0.00, "blue sky (above old high)", 0.95, 3896),
    (0.00, 0.02, "<2% below the old high", 0.88, 349),
    (0.02, 0.10, "2-10% below", 0.62, 992),
    (0.10, 0.25, "10-25% below", 0.33, 719),
    (0.25, 9.00, ">25% below", 0.08, 1063),
]


def ath_bucket(dist: Column) -> Column:
    """Bucket of the distance to the old high as a struct; beyond the table it
    falls in the farthest bucket."""
    cells = [
        F.struct(F.lit(label).alias("label"), F.lit(p).alias("p_reach"), F.lit(n).cast("long").alias("n"))
        for _, _, label, p, n in ATH_BY_DISTANCE
    ]
    out = None
    for (lo, hi, *_), cell in zip(ATH_BY_DISTANCE, cells):
        cond = (dist >= lo) & (dist < hi)
        out = F.when(cond, cell) if out is None else out.when(cond, cell)
    return out.otherwise(cells[-1])


def pivot_high(k: int, c: str = "high") -> Column:
    """True on a bar strictly above the ``k`` bars on both sides."""
    left, right = F.max(c).over(w.ahead(-k, -1)), F.max(c).over(w.ahead(1, k))
    full = (F.count(c).over(w.ahead(-k, -1)) == k) & (F.count(c).over(w.ahead(1, k)) == k)
    return w.flag(full & (F.col(c) > left) & (F.col(c) > right))


def confirmed_pivots(df: DataFrame, k: int = 5) -> DataFrame:
    """Bars with ``pivot``: the value of a pivot that becomes known on this bar."""
    x = df.withColumn("__p", F.when(pivot_high(k), F.col("high")))
    return x.withColumn("pivot", w.lag("__p", k)).drop("__p")


def swing_touches(df: DataFrame, lookback: int = LOOKBACK, k: int = PIVOT, tol: float = TOL) -> DataFrame:
    """Pivots inside the window before the newest bar that came within ``tol``
    of its highest high."""
    x = R.aged(df.withColumn("__p", pivot_high(k)))
    x = x.withColumn("__level", F.max(R.within(1, lookback, "high")).over(w.whole()))
    near = F.abs(F.col("high") - F.col("__level")) / F.col("__level") <= tol
    seen = F.col("__p") & F.col(R.AGE).between(1 + k, lookback - k) & near
    return x.groupBy("symbol").agg(F.max("__level").alias("level"), F.count(F.when(seen, 1)).alias("touches"))


def resistance_state(df: DataFrame) -> DataFrame:
    """The prior 50-bar high, touches, volume surge, trend and the state."""
    x = R.aged(df.withColumn("__p", pivot_high(PIVOT)))
    x = x.withColumn("__level", F.max(R.within(1, LOOKBACK, "high")).over(w.whole()))
    x = x.withColumn("__hold", F.max(R.within(HOLD + 1, HOLD + LOOKBACK, "high")).over(w.whole()))
    near = F.abs(F.col("high") - F.col("__level")) / F.col("__level") <= TOL
    seen = F.col("__p") & F.col(R.AGE).between(1 + PIVOT, LOOKBACK - PIVOT) & near
    recent = R.within(0, HOLD - 1, (F.col("close") > F.coalesce("__hold", "__level")).cast("double"))
    g = x.groupBy("symbol").agg(
        F.count("close").alias("__n"),
        R.at(0).alias("price"),
        R.at(1).alias("__c1"),
        F.max("__level").alias("level"),
        F.max(R.within(2, LOOKBACK + 1, "high")).alias("__level1"),
        F.count(F.when(seen, 1)).alias("touches"),
        F.max(F.when(F.col(R.AGE) >= 1, F.col("close"))).alias("ath"),
        F.count("volume").alias("__nv"),
        R.at(0, "volume").alias("__v"),
        F.avg(R.within(1, LOOKBACK, "volume")).alias("__va"),
        R.tail(F.avg, 200).alias("__sma200"),
        F.avg(recent).alias("__frac"),
    ).where(F.col("__n") >= LOOKBACK + PIVOT + 5)
    p = F.col("price")
    above, was = p > F.col("level"), F.col("__c1") > F.col("__level1")
    pct = w.ratio("level", p) - 1.0
    dist = w.ratio("ath", p) - 1.0
    surge = F.when((F.col("__nv") > LOOKBACK) & (F.col("__va") > 0), F.col("__v") > 1.5 * F.col("__va"))
    state = (
        F.when(above & ~was, "fresh_breakout")
        .when(above & (F.col("__frac") >= 0.6), "holding_above")
        .when(above, "choppy_above")
        .when(pct <= NEAR, "approaching")
        .otherwise("below")
    )
    g = g.withColumns({"pct_to_level": pct, "dist_ath": dist, "volume_surge": surge, "uptrend": p > F.col("__sma200"), "state": state})
    b = ath_bucket(F.col("dist_ath"))
    return g.select(
        "symbol",
        "price",
        "level",
        "touches",
        "pct_to_level",
        "state",
        "ath",
        "dist_ath",
        b["label"].alias("ath_bucket"),
        b["p_reach"].alias("p_reach_ath_63d"),
        "volume_surge",
        "uptrend",
        (w.flag(F.col("uptrend")) & w.flag(F.col("volume_surge")) & (F.col("dist_ath") < 0.10)).alias("best_combo"),
    )


def fresh_breaks(df: DataFrame) -> DataFrame:
    """Every fresh close above the prior 50-bar high with what followed."""
    x = df.withColumns(
        {
            "i": w.bar_no(),
            "n": w.n_bars(),
            "level": w.roll(F.max, "high", LOOKBACK, 1),
            "prior_high": F.max("close").over(w.history(shift=1)),
            "c1": w.lag("close"),
            "volume_surge": w.flag(F.col("volume") > 1.5 * w.roll(F.avg, "volume", LOOKBACK, 1)),
        }
    ).withColumn("level1", w.lag("level"))
    for h in (5, 21, 63):
        f = w.ahead(1, h)
        x = x.withColumns({f"n{h}": F.count("close").over(f), f"max{h}": F.max("close").over(f), f"min{h}": F.min("close").over(f)})
    closes = F.collect_list("close").over(w.ahead(1, 21))
    x = x.withColumn("__next", closes)
    fresh = (F.col("close") > F.col("level")) & (F.col("c1") <= F.col("level1")) & (F.col("i") < F.col("n") - 1)
    held = F.size(F.filter("__next", lambda c: c > F.col("level"))) / F.size("__next")
    return x.where(fresh).select(
        "symbol",
        "ts",
        "n",
        "level",
        "close",
        "prior_high",
        "volume_surge",
        F.when(F.col("n5") >= 3, F.col("max5") > F.col("close")).alias("pushed_higher_5"),
        F.when(F.col("n21") >= 12, F.col("min21") < F.col("level")).alias("retest_21"),
        F.when(F.col("n21") >= 12, F.col("min21") < F.col("level") * 0.97).alias("failed_21"),
        F.when(F.col("n21") >= 12, held >= 0.8).alias("held_21"),
        F.when(F.col("n63") >= 35, F.col("max63") >= F.col("prior_high")).alias("reached_high_63"),
    )


def breakout_track_record(df: DataFrame, min_events: int = 8) -> DataFrame:
    ev = fresh_breaks(df).where(F.col("n") >= LOOKBACK + 80)
    names = ["pushed_higher_5", "retest_21", "failed_21", "reached_high_63"]
    g = ev.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("events"), *[F.avg(F.col(c).cast("double")).alias(c) for c in names]
    )
    return g.where(F.col("events") >= min_events)


def breakout_path_rates(df: DataFrame) -> DataFrame:
    """Pooled path rates of fresh breaks, split by volume surge and by the
    distance to the old high at the break."""
    ev = fresh_breaks(df)
    ev = ev.withColumn("bucket", ath_bucket(w.ratio("prior_high", "close") - 1.0)["label"])
    cut = F.array(
        F.lit("all"), F.when(F.col("volume_surge"), "volume").otherwise("no_volume"), F.concat(F.lit("ath: "), F.col("bucket"))
    )
    names = ["retest_21", "failed_21", "held_21", "reached_high_63"]
    return (
        ev.withColumn("cut", F.explode(cut))
        .groupBy("cut")
        .agg(F.count(F.lit(1)).alias("events"), *[F.avg(F.col(c).cast("double")).alias(c) for c in names])
    )


def approach_rates(df: DataFrame) -> DataFrame:
    """First bars within 2% below the level: broke above, or fell over 5%, in 21 bars."""
    level = w.roll(F.max, "high", LOOKBACK, 1)
    x = df.withColumn("level", level).withColumn(
        "__in", w.flag((F.col("close") <= F.col("level")) & (F.col("level") / F.col("close") - 1.0 <= NEAR))
    )
    x = x.withColumns(
        {
            "__was": F.coalesce(w.lag("__in"), F.lit(False)),
            "__max": F.max("close").over(w.ahead(1, 21)),
            "__min": F.min("close").over(w.ahead(1, 21)),
            "__n": F.count("close").over(w.ahead(1, 21)),
        }
    )
    ev = x.where(F.col("__in") & ~F.col("__was") & (F.col("__n") == 21))
    return ev.agg(
        F.count(F.lit(1)).alias("episodes"),
        F.avg((F.col("__max") > F.col("level")).cast("double")).alias("broke_21"),
        F.avg((F.col("__min") < 0.95 * F.col("close")).cast("double")).alias("fell_5pct_21"),
    )


def nearest_pivot_breaks(df: DataFrame, k: int = 5, mature: int = 260, width: float = 0.01) -> DataFrame:
    """Bars that close above the nearest confirmed pivot over the prior close.

    A break needs a pivot between the prior close and the close, so bars and
    pivots meet on (symbol, log price bin) instead of all history: each rising
    bar carries the few bins it crosses.  ``notable`` asks that the nearest
    pivot stands above the pivot confirmed before it."""
    x = confirmed_pivots(df, k).withColumns(
        {"i": w.bar_no(), "prev": w.lag("close"), "__mature": F.count("close").over(w.trailing(mature)) >= mature}
    )
    piv = x.where(F.col("pivot").isNotNull()).select("symbol", F.col("i").alias("known"), "pivot")
    piv = piv.withColumn("before", F.lag("pivot").over(Window.partitionBy("symbol").orderBy("known")))
    at = F.floor(F.log("pivot") / F.lit(width)).cast("long")
    piv = piv.select("symbol", at.alias("bin"), "known", "pivot", "before")
    rising = x.where(F.col("__mature") & (F.col("close") > F.col("prev"))).select(
        "symbol", "ts", "i", "close", "prev", F.explode(joins.bins(F.col("prev"), F.col("close"), width)).alias("bin")
    )
    met = rising.join(piv, ["symbol", "bin"]).where(
        (F.col("known") < F.col("i")) & (F.col("pivot") > F.col("prev")) & (F.col("pivot") < F.col("close"))
    )
    g = met.groupBy("symbol", "ts").agg(
        F.min_by(F.struct("pivot", "before"), F.struct("pivot", "known")).alias("__b")
    )
    return g.select(
        "symbol",
        "ts",
        F.col("__b.pivot").alias("level"),
        w.flag(F.col("__b.pivot") > F.col("__b.before")).alias("notable"),
    )


def multi_touch_breaks(df: DataFrame, window: int = 120, k: int = PIVOT, tol: float = TOL, min_touch: int = 3) -> DataFrame:
    """First closes above a ceiling touched by at least ``min_touch`` pivots in
    the window and never closed above."""
    x = df.withColumn("__p", F.when(pivot_high(k), F.col("high")))
    x = x.withColumns(
        {
            "__ps": F.collect_list("__p").over(w.ahead(-(window - k), -(k + 1))),
            "__top": F.max("close").over(w.trailing(window, 1)),
            "prev": w.lag("close"),
            "i": w.bar_no(),
        }
    )
    near = lambda ps, a: F.filter(ps, lambda p: F.abs(p / a - 1.0) <= tol)
    cells = F.transform(
        "__ps",
        lambda a, j: F.struct(F.size(near(F.col("__ps"), a)).alias("count"), (-j).alias("order"), F.array_max(near(F.col("__ps"), a)).alias("level")),
    )
    x = x.where((F.col("i") >= window + k) & (F.size("__ps") >= min_touch)).withColumn("__best", F.array_max(cells))
    r = F.col("__best.level")
    hit = (F.col("__best.count") >= min_touch) & (F.col("__top") <= r) & (F.col("prev") <= r) & (F.col("close") > r)
    return x.where(hit).select("symbol", "ts", r.alias("level"), F.col("__best.count").cast("long").alias("touches"))


def volume_shelf(df: DataFrame, window: int = 120, bins: int = 30, grid: int = 5) -> DataFrame:
    """Bars with ``shelf``: the centre of the heaviest volume bin over the close,
    recomputed every ``grid`` bars and held for at most ``grid`` more.

    A grid bar carries its bounded window; each bar of it is spread over just
    the bins it touches and the profile is a hash aggregation by (symbol, grid
    bar, bin).  Bars off the grid are dropped before anything is exploded."""
    past = w.trailing(window, 1)
    bar = F.struct("high", "low", F.coalesce("volume", F.lit(0.0)).alias("volume"))
    x = df.withColumns({"i": w.bar_no(), "__lo": F.min("low").over(past), "__hi": F.max("high").over(past)})
    on_grid = (F.col("i") >= window) & ((F.col("i") - window) % grid == 0) & (F.col("__hi") > F.col("__lo"))
    a = x.withColumn("__bars", F.collect_list(bar).over(past)).where(on_grid)
    a = a.withColumn("__w", (F.col("__hi") - F.col("__lo")) / float(bins)).select(
        "symbol", "ts", "close", "__lo", "__w", F.inline("__bars").alias("h", "l", "v")
    )

    def home(p: Column) -> Column:
        return F.greatest(F.least(F.floor((p - F.col("__lo")) / F.col("__w")), F.lit(bins - 1)), F.lit(0))

    a = a.where(F.col("v") > 0).select("*", F.explode(F.sequence(home(F.col("l")), home(F.col("h")))).alias("b"))
    edge = F.col("__lo") + F.col("__w") * F.col("b")
    overlap = F.greatest(F.least(edge + F.col("__w"), F.col("h")) - F.greatest(edge, F.col("l")), F.lit(0.0))
    part = F.when(F.col("h") > F.col("l"), F.col("v") * overlap / (F.col("h") - F.col("l"))).otherwise(F.col("v"))
    centre = F.col("__lo") + F.col("__w") * (F.col("b") + 0.5)
    g = a.where(centre > F.col("close")).groupBy("symbol", "ts", "b").agg(F.sum(part).alias("v"), F.max(centre).alias("c"))
    g = g.where(F.col("v") > 0).groupBy("symbol", "ts").agg(F.max_by("c", F.struct(F.col("v"), -F.col("b"))).alias("__shelf"))
    y = x.select(*df.columns, "i").join(g, ["symbol", "ts"], "left")
    return y.withColumn("shelf", F.last("__shelf", ignorenulls=True).over(w.by().rowsBetween(-grid, 0))).select(
        *df.columns, "i", "shelf"
    )


def volume_shelf_breaks(df: DataFrame, window: int = 120) -> DataFrame:
    """Bars that cross a shelf also known one bar earlier."""
    x = volume_shelf(df, window)
    x = x.withColumn("__above", w.flag(F.col("close") > F.col("shelf")))
    x = x.withColumns({"__was": F.coalesce(w.lag("__above"), F.lit(False)), "__r1": w.lag("shelf")})
    hit = F.col("__above") & ~F.col("__was") & F.col("__r1").isNotNull() & (F.col("i") >= window + 4)
    return x.where(hit).select("symbol", "ts", "shelf")


def prior_peak_retest(mature: int = 300) -> Column:
    """Close back over the high of 252..126 bars ago after a fall of 10% and a
    prior close within 3% under it."""
    peak = w.roll(F.max, "high", 126, 126)
    low = w.roll(F.min, "low", 126, 1)
    prev = w.lag("close")
    enough = F.count("close").over(w.trailing(mature)) >= mature
    return w.flag(
        (low <= peak * 0.9) & (prev <= peak) & (prev >= peak * 0.97) & (F.col("close") > peak) & enough
    )


def with_round_number_break(df: DataFrame, out: str = "round_break") -> DataFrame:
    """Close over a round level the price camped within 4% under for at least
    10 of the 20 bars before."""
    x = df.withColumn("__r", I.round_level(w.lag("close"))).withColumn("__prev", w.lag("close"))
    under = w.flag((F.col("close") < F.col("__r")) & ((F.col("__r") - F.col("close")) / F.col("__r") <= 0.04))
    x = x.withColumn("__u", under.cast("int"))
    stuck = w.roll(F.sum, "__u", 20, 1) >= 10
    enough = F.count("close").over(w.trailing(25)) >= 25
    hit = stuck & (F.col("__prev") < F.col("__r")) & (F.col("close") > F.col("__r")) & enough
    return x.withColumn(out, w.flag(hit)).drop("__r", "__u", "__prev")


def with_level_masks(df: DataFrame) -> DataFrame:
    """The six level studies as boolean columns on the bars."""
    x = with_round_number_break(df.withColumn("prior_peak", prior_peak_retest()))
    nb = nearest_pivot_breaks(df).select("symbol", "ts", F.lit(True).alias("swinghigh_basic"), F.col("notable").alias("swinghigh_notable"))
    mt = multi_touch_breaks(df).select("symbol", "ts", F.lit(True).alias("multi_touch"))
    vs = volume_shelf_breaks(df).select("symbol", "ts", F.lit(True).alias("volume_shelf"))
    for other in (nb, mt, vs):
        x = x.join(other, ["symbol", "ts"], "left")
    return x


LEVEL_MASKS = ["multi_touch", "swinghigh_basic", "swinghigh_notable", "prior_peak", "round_break", "volume_shelf"]
