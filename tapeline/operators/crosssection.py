"""Sector, peer and same-date comparisons.

Groups here are (sector, date) or (date): a sector with a third of all symbols
is still split over its dates.  Market series have one row per date.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import session
from ..functions import ranks, stats
from ..functions import windows as w
from ..sources import bars as B
from . import study as S

MOVE = 0.01
BROAD = 0.8
MIN_MEMBERS = 4
# fixed values: bars of a member that counts, dates of a sector whose peers are compared
MIN_BARS, MIN_DATES = 25, 40


def with_returns(df: DataFrame, ns: Sequence[int] = (1, 5, 21)) -> DataFrame:
    return df.withColumns({f"r{n}": w.ret("close", w.lag("close", n)) for n in ns})


def sector_pulse(df: DataFrame, broad: float = BROAD, min_members: int = MIN_MEMBERS, min_bars: int = MIN_BARS, every: bool = False) -> DataFrame:
    """Members with their sector's day: shares beyond -+1%, the event, sector
    means, the gap to the sector over 21 bars and survivors of a selloff.

    A member counts from its ``min_bars``-th bar on, a day if ``min_members`` and
    half of the sector's symbols count.  With ``every`` all members that moved
    count and have their row on days with ``min_members`` of them; ``available``
    tells whether row and day meet the two rules."""
    size = df.groupBy("sector", "symbol").agg(F.count(F.lit(1))).groupBy("sector").agg(F.count(F.lit(1)).alias("__size"))
    x = with_returns(df).withColumn("__old", w.bar_no() >= min_bars - 1).where(F.col("r1").isNotNull())
    x = x if every else x.where("__old")
    size = size.withColumnRenamed("sector", "__s")
    x = x.join(size, F.col("sector").eqNullSafe(F.col("__s")) if every else F.col("sector") == F.col("__s")).drop("__s")
    day = Window.partitionBy("sector", "ts")
    mean = lambda c: F.avg(c).over(day)
    x = x.withColumns(
        {
            "n_members": F.count("r1").over(day),
            "frac_down": mean((F.col("r1") < -MOVE).cast("double")),
            "frac_up": mean((F.col("r1") > MOVE).cast("double")),
            "sector_today": mean(F.col("r1")),
            "sector_r5": mean(F.col("r5")),
            "sector_r21": mean(F.col("r21")),
        }
    )
    need = F.greatest(F.lit(min_members), F.floor(F.col("__size") / 2))
    if every:
        x = x.withColumn("available", F.col("__old") & (F.count_if("__old").over(day) >= need)).where(F.col("n_members") >= min_members)
    else:
        x = x.where(F.col("n_members") >= need)
    x = x.drop("__size", "__old")
    event = F.when(F.col("frac_down") >= broad, "broad_selloff").when(F.col("frac_up") >= broad, "broad_rally")
    return x.withColumn("event", event).withColumns(
        {
            "survivor": w.flag((F.col("event") == "broad_selloff") & (F.col("r1") > 0)),
            "gap21": F.col("r21") - F.col("sector_r21"),
        }
    )


def closest_peers(df: DataFrame, anchors: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` sector peers whose returns correlate most with each anchor.

    Only the symbols asked about are paired with their peers, date by date, and
    the pairs collapse map-side into one correlation per (anchor, peer)."""
    r = df.select("symbol", "sector", "ts", "r1").where(F.col("r1").isNotNull())
    a = r.join(anchors.select("symbol"), "symbol", "left_semi").select(
        F.col("symbol").alias("anchor"), "sector", "ts", F.col("r1").alias("__ra")
    )
    pairs = a.join(r.select(F.col("symbol").alias("peer"), "sector", "ts", "r1"), ["sector", "ts"]).where(
        F.col("anchor") != F.col("peer")
    )
    c = pairs.groupBy("anchor", "peer").agg(stats.corr("__ra", "r1").alias("corr")).where(F.col("corr").isNotNull())
    spec = Window.partitionBy("anchor").orderBy(F.desc("corr"), "peer")
    return c.withColumn("pos", F.row_number().over(spec).cast("long")).where(F.col("pos") <= k)


def move_attribution(df: DataFrame, big: float = 0.025, k: int = 3) -> DataFrame:
    """For each symbol whose newest bar moved by ``big``: its closest peers'
    mean move, the residual, and stock-specific against group move.  Symbols
    need MIN_BARS bars, their sector MIN_DATES dates."""
    x = with_returns(df, (1,)).withColumns({"__a": w.bars_ago(), "__n": w.n_bars()}).where(F.col("__n") >= MIN_BARS)
    long = x.groupBy("sector", "ts").agg(F.count(F.lit(1))).groupBy("sector").agg(F.count(F.lit(1)).alias("__d")).where(F.col("__d") >= MIN_DATES)
    now = x.where(F.col("__a") == 0).select("symbol", "sector", "r1")
    movers = now.where(F.abs("r1") >= big).join(long.select("sector"), "sector", "left_semi").select(*now.columns)
    peers = closest_peers(x, movers, k)
    p = peers.join(now.select(F.col("symbol").alias("peer"), F.col("r1").alias("__p")), "peer")
    g = p.groupBy(F.col("anchor").alias("symbol")).agg(
        F.avg("__p").alias("peer_move"), F.array_join(F.array_sort(F.collect_list("peer")), ",").alias("peers")
    )
    me, pm = F.col("move"), F.col("peer_move")
    return (
        movers.join(g, "symbol")
        .select("symbol", F.col("r1").alias("move"), "peers", "peer_move", (F.col("r1") - pm).alias("residual"))
        .withColumn(
            "attribution",
            F.when((F.abs(pm) < 0.01) & (F.abs("residual") >= 0.02), "stock_specific").when(
                (F.signum(pm) == F.signum(me)) & (F.abs(pm) >= 0.5 * F.abs(me)), "group_move"
            ),
        )
    )


def keep_spaced(events: DataFrame, keys: Sequence[str], at: str, gap: int, payload: Sequence[str] = ()) -> DataFrame:
    """Greedy de-overlap: keep an event only if more than ``gap`` after the last
    kept one.

    An event more than ``gap`` after its predecessor is kept whatever came
    before, so events between two such gaps form an island that is folded alone."""
    item = F.struct(F.col(at).cast("long").alias("__k"), *payload)
    order = Window.partitionBy(*keys).orderBy("__at")
    x = events.withColumn("__at", F.col(at).cast("long"))
    x = x.withColumn("__new", (F.col("__at") - F.lag("__at").over(order) > gap).cast("int"))
    x = x.withColumn("__island", F.sum(F.coalesce("__new", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    e = x.groupBy(*keys, "__island").agg(F.array_sort(F.collect_list(item)).alias("__e"))
    kind = events.select(F.array(item).alias("k")).schema["k"].dataType

    def step(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)["__k"]
        return F.when(last.isNull() | (x["__k"] - last > gap), F.concat(acc, F.array(x))).otherwise(acc)

    return e.withColumn("__f", F.aggregate("__e", F.array().cast(kind), step)).select(*keys, F.inline("__f")).drop("__k")


def sector_events(df: DataFrame, share: float = BROAD, coverage: float = 0.7, min_size: int = 5, days: int = 30) -> DataFrame:
    """De-overlapped (sector, ts) on which ``share`` of all members fell 1%."""
    x = with_returns(df, (1,))
    size = x.groupBy("sector").agg(F.count_distinct("symbol").alias("size"))
    d = x.groupBy("sector", "ts").agg(
        F.count(F.when(F.col("r1") < -MOVE, 1)).alias("down"), F.count("r1").alias("present")
    )
    ev = d.join(size, "sector").where(
        (F.col("size") >= min_size)
        & (F.col("down") / F.col("size") >= share)
        & (F.col("present") / F.col("size") > coverage)
    )
    ev = ev.withColumn("__day", F.unix_date(F.to_date("ts")))
    return session.keep(keep_spaced(ev, ["sector"], "__day", days, ["ts"]))


def sector_event_study(df: DataFrame, horizons: Sequence[int] = (5, 21), min_events: int = 8, **kw) -> DataFrame:
    """Sector against market after sector-wide down days."""
    ev = sector_events(df, **kw)
    x = S.forward(df, horizons)
    days = ev.select("ts").distinct()
    mkt = x.join(days, "ts").groupBy("ts").agg(*[F.avg(f"fwd_{h}").alias(f"m{h}") for h in horizons])
    sec = x.join(ev, ["sector", "ts"]).groupBy("sector", "ts").agg(*[F.avg(f"fwd_{h}").alias(f"s{h}") for h in horizons])
    rows = sec.join(mkt, "ts").select(
        "sector",
        F.inline(
            F.array(*[F.struct(F.lit(h).cast("long").alias("horizon"), F.col(f"s{h}").alias("s"), F.col(f"m{h}").alias("m")) for h in horizons])
        ),
    )
    rows = rows.where(F.col("s").isNotNull() & F.col("m").isNotNull()).withColumn("diff", F.col("s") - F.col("m"))
    g = rows.groupBy("sector", "horizon").agg(
        F.count("s").alias("n"), F.avg("s").alias("sector_fwd"), F.avg("diff").alias("vs_market"), stats.t_of("diff").alias("t")
    )
    return g.where(F.col("n") >= min_events)


def survivor_study(df: DataFrame, h: int = 5, **kw) -> DataFrame:
    """Members green on an event day against every symbol-day."""
    ev = sector_events(df, **kw).withColumn("__ev", F.lit(True))
    x = S.forward(with_returns(df, (1,)), [h]).where(F.col(f"fwd_{h}").isNotNull())
    x = x.join(ev, ["sector", "ts"], "left")
    alive = w.flag(F.col("__ev") & (F.col("r1") > 0))
    f = F.col(f"fwd_{h}")
    return x.agg(
        F.count(F.when(alive, 1)).alias("n_survivors"),
        F.avg(F.when(alive, f)).alias("survivor_fwd"),
        F.avg(F.when(alive, (f > 0).cast("double"))).alias("survivor_win"),
        F.count(f).alias("n_all"),
        F.avg(f).alias("all_fwd"),
        F.avg((f > 0).cast("double")).alias("all_win"),
    )


def laggard_catchup(df: DataFrame, h: int = 21, start: int = 252, k: int = 2, min_names: int = 5) -> DataFrame:
    """Worst ``k`` minus best ``k`` of a sector by relative h-bar return, next h
    bars, on every h-th date."""
    x = S.forward(with_returns(df, (h,)), [h])
    x = B.with_calendar(x).where((F.col("ci") >= start) & ((F.col("ci") - start) % h == 0))
    x = x.where(F.col(f"r{h}").isNotNull())
    day = Window.partitionBy("sector", "ts")
    x = x.withColumns(
        {
            "__n": F.count(F.lit(1)).over(day),
            "rel": F.col(f"r{h}") - F.avg(f"r{h}").over(day),
            "frel": F.col(f"fwd_{h}") - F.avg(f"fwd_{h}").over(day),
        }
    ).where(F.col("__n") >= min_names)
    x = x.withColumns(
        {
            "lo": F.row_number().over(day.orderBy("rel", "symbol")),
            "hi": F.row_number().over(day.orderBy(F.desc("rel"), "symbol")),
        }
    )
    v = x.groupBy("sector", "ts").agg(
        (F.avg(F.when(F.col("lo") <= k, F.col("frel"))) - F.avg(F.when(F.col("hi") <= k, F.col("frel")))).alias("v")
    )
    return v.agg(F.avg("v").alias("mean_diff"), stats.t_of("v").alias("t"), F.count("v").alias("n"))


def lead_lag(df: DataFrame, leader: str, follower: str, h: int = 21) -> DataFrame:
    """Same-window correlation of two sectors' h-date returns, and the
    follower's next window after a leader's above- and below-median one."""
    x = with_returns(df, (1,)).where(F.col("sector").isin(leader, follower))
    day = x.groupBy("ts").agg(
        F.avg(F.when(F.col("sector") == leader, F.col("r1"))).alias("a"),
        F.avg(F.when(F.col("sector") == follower, F.col("r1"))).alias("b"),
    )
    day = day.join(B.calendar(df), "ts").withColumn("win", F.floor(F.col("ci") / h))
    win = day.groupBy("win").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    # one row per h dates: a calendar-sized table
    order = Window.partitionBy(F.lit(0)).orderBy("win")
    win = win.withColumns({"nb": F.lead("b").over(order), "med": F.percentile("a", F.lit(0.5)).over(Window.partitionBy(F.lit(0)))})
    hi = F.col("a") > F.col("med")
    return win.agg(
        F.count(F.lit(1)).alias("windows"),
        stats.corr("a", "b").alias("same_corr"),
        stats.corr("a", "nb").alias("lead_corr"),
        (F.avg(F.when(hi, F.col("nb"))) - F.avg(F.when(~hi, F.col("nb")))).alias("hi_lo"),
    )


def runup_events(df: DataFrame, spike: float = 3.5, gap: int = 40) -> DataFrame:
    """Volume-spike events at least ``gap`` bars apart with the 10-bar run-up
    before and the 21-bar return after."""
    x = df.withColumns(
        {
            "i": w.bar_no(),
            "n": w.n_bars(),
            "__avg": w.roll(F.avg, "volume", 50, 1),
            "runup": w.ret(w.lag("close", 1), w.lag("close", 11)),
            "post": w.ret(w.lead("close", 21), "close"),
        }
    )
    ev = x.where(
        (F.col("volume") > spike * F.col("__avg")) & (F.col("i") > 11) & (F.col("i") + 22 < F.col("n")) & F.col("runup").isNotNull()
    )
    return keep_spaced(ev, ["symbol"], "i", gap, ["ts", "runup", "post"])


def runup_event_study(df: DataFrame, spike: float = 3.5, gap: int = 40) -> DataFrame:
    """Returns after the top and bottom 30% of run-ups and their pooled t."""
    e = session.keep(runup_events(df, spike, gap).withColumn("__one", F.lit("all")))
    q = ranks.exact_quantiles(e, ["__one"], "runup", {"q70": 0.7, "q30": 0.3})
    # the quantile table is a single row
    x = e.join(F.broadcast(q), "__one")
    hi, lo, p = F.col("runup") >= F.col("q70"), F.col("runup") <= F.col("q30"), F.col("post")
    g = x.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(hi, p)).alias("big_runup"),
        F.var_samp(F.when(hi, p)).alias("__v1"),
        F.count(F.when(hi, 1)).alias("__n1"),
        F.avg(F.when(lo, p)).alias("weak_runup"),
        F.var_samp(F.when(lo, p)).alias("__v2"),
        F.count(F.when(lo, 1)).alias("__n2"),
    )
    t = stats.t_two_sample(*[F.col(c) for c in ("big_runup", "__v1", "__n1", "weak_runup", "__v2", "__n2")])
    return g.select("n", "big_runup", "weak_runup", t.alias("t"))


def twin_divergence(df: DataFrame, pairs: DataFrame, drop: float = 0.025, h: int = 5) -> DataFrame:
    """Days one twin fell by ``drop`` and the other did not: the untouched
    twin's next ``h`` bars against every symbol-day.  ``pairs`` names twins."""
    x = S.forward(with_returns(df, (1,)), [h]).select("symbol", "ts", "r1", F.col(f"fwd_{h}").alias("f"))
    both = pairs.select(F.col("a").alias("hit"), F.col("b").alias("other")).unionByName(
        pairs.select(F.col("b").alias("hit"), F.col("a").alias("other"))
    )
    hit = x.where(F.col("r1") < -drop).select(F.col("symbol").alias("hit"), "ts").join(both, "hit")
    calm = x.where((F.col("r1") >= -drop) & F.col("f").isNotNull())
    ev = calm.join(hit.select(F.col("other").alias("symbol"), "ts"), ["symbol", "ts"])
    u = ev.select(F.lit("untouched_twin").alias("grp"), "f").unionByName(
        x.where(F.col("f").isNotNull()).select(F.lit("all").alias("grp"), "f")
    )
    return u.groupBy("grp").agg(F.count("f").alias("n"), F.avg("f").alias("mean_fwd"), stats.rate(F.col("f") > 0).alias("win_rate"))


def bellwether_crash(df: DataFrame, drop: float = 0.05) -> DataFrame:
    """The market's same-day and next-day mean return when a name falls by ``drop``."""
    x = with_returns(df, (1,)).where(F.col("r1").isNotNull())
    m = x.groupBy("ts").agg(F.avg("r1").alias("mkt"))
    m = m.withColumn("nxt", F.lead("mkt").over(Window.partitionBy(F.lit(0)).orderBy("ts")))
    hit = x.where(F.col("r1") <= -drop).select("symbol", "ts").join(m, "ts")
    base = m.select(F.lit("(any day)").alias("symbol"), "mkt", "nxt")
    u = hit.select("symbol", "mkt", "nxt").unionByName(base)
    return u.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg("mkt").alias("same_day"), F.avg("nxt").alias("next_day"))


def momentum_spread(df: DataFrame, horizons: Sequence[int], min_names: int = 9, start: int = 260) -> DataFrame:
    """Top minus bottom tercile by 6-month return per sampled date.

    Terciles are percentiles of one date's symbols, on sampled dates only."""
    x = S.forward(df.withColumn("mom6", w.ret("close", w.lag("close", 126))), horizons)
    x = B.with_calendar(x).where(F.col("mom6").isNotNull())
    cells = [
        F.when(
            w.flag(S.sampled(h, start)), F.struct(F.lit(h).cast("long").alias("horizon"), F.col(f"fwd_{h}").alias("fwd"))
        )
        for h in horizons
    ]
    rows = x.select("ts", "mom6", F.inline(F.filter(F.array(*cells), lambda s: s.isNotNull())))
    q = rows.groupBy("horizon", "ts").agg(
        F.count("mom6").alias("__n"),
        F.percentile("mom6", F.lit(2.0 / 3)).alias("hi"),
        F.percentile("mom6", F.lit(1.0 / 3)).alias("lo"),
    ).where(F.col("__n") >= min_names)
    j = rows.join(q, ["horizon", "ts"])
    d = j.groupBy("horizon", "ts").agg(
        (
            F.avg(F.when(F.col("mom6") >= F.col("hi"), F.col("fwd"))) - F.avg(F.when(F.col("mom6") <= F.col("lo"), F.col("fwd")))
        ).alias("diff")
    )
    return d.groupBy("horizon").agg(F.avg("diff").alias("top_minus_bottom"), stats.t_of("diff").alias("t"), F.count("diff").alias("n_dates"))


def setup_score(rsi: Column, price: Column, sma20: Column, sma200: Column, rs: Column, reversal: Column | None = None) -> Column:
    """0-100 score of a pullback in an outperforming uptrend; 0 off the gate."""
    gate = (price > sma200) & (rs > 0)
    dip = w.clip((55 - rsi) / 30, 0.0, 1.0)
    pull = w.clip((sma20 / price - 1) / 0.05, 0.0, 1.0)
    bonus = F.when(w.flag(reversal), 8.0).otherwise(0.0) if reversal is not None else F.lit(0.0)
    score = F.least(100 * (0.55 * dip + 0.35 * pull + 0.10) + bonus, F.lit(100.0))
    return F.when(w.flag(gate) & rsi.isNotNull(), score).otherwise(0.0)


def scanner_backtest(df: DataFrame, every: int = 3, start: int = 210, k: int = 5, min_names: int = 6) -> DataFrame:
    """Mean forward return of the top and bottom ``k`` by score and of all names
    on every ``every``-th date, with the paired t of top against all.  Needs
    ``score`` on the bars."""
    hs = (5, 21)
    x = B.with_calendar(S.forward(df, hs))
    x = x.where((F.col("ci") >= start) & (F.col("ci") < F.col("cn") - 21) & ((F.col("ci") - start) % every == 0))
    day = Window.partitionBy("ts")
    scored = F.when(F.col("score") > 0, F.col("score"))
    x = x.withColumn("__n", F.count(scored).over(day)).where(F.col("__n") >= min_names)
    ok = scored.isNotNull()
    x = x.withColumns(
        {
            "top": ok & (F.row_number().over(Window.partitionBy("ts", ok).orderBy(F.desc("score"), "symbol")) <= k),
            "bot": ok & (F.row_number().over(Window.partitionBy("ts", ok).orderBy("score", "symbol")) <= k),
        }
    )
    d = x.groupBy("ts").agg(
        *[
            F.avg(F.when(cond, F.col(f"fwd_{h}"))).alias(f"{g}_{h}")
            for g, cond in (("top", F.col("top")), ("bottom", F.col("bot")), ("all", F.lit(True)))
            for h in hs
        ]
    )
    cells = [
        F.struct(
            F.lit(g).alias("grp"), F.lit(h).cast("long").alias("horizon"), F.col(f"{g}_{h}").alias("v"), (F.col(f"{g}_{h}") - F.col(f"all_{h}")).alias("diff")
        )
        for g in ("top", "bottom", "all")
        for h in hs
    ]
    return (
        d.select(F.inline(F.array(*cells)))
        .groupBy("grp", "horizon")
        .agg(
            F.count("v").alias("n_dates"),
            F.avg("v").alias("mean_fwd"),
            stats.rate(F.col("v") > 0).alias("win_rate"),
            F.avg("diff").alias("edge"),
            stats.t_of("diff").alias("paired_t"),
        )
    )


def in_out_of_sample(df: DataFrame, rules: dict[str, Column], h: int = 21, warm: int = 210, split: float = 0.6, hold: str = "hold") -> DataFrame:
    """Best rule per symbol in the first part and what it did in the second."""
    x = S.forward(df, [h]).withColumns({"i": w.bar_no(), "n": w.n_bars()})
    cut = F.floor(F.col("n") * split)
    win = w.flag(F.col(f"fwd_{h}") > 0).cast("double")
    part = F.when((F.col("i") >= warm) & (F.col("i") < cut), "in").when(
        (F.col("i") >= cut) & (F.col("i") < F.col("n") - h), "out"
    )
    cells = [F.when(w.flag(c), F.struct(F.lit(k).alias("ord"), F.lit(name).alias("rule"))) for k, (name, c) in enumerate(rules.items())]
    rows = x.select("symbol", part.alias("part"), win.alias("win"), F.inline(F.filter(F.array(*cells), lambda s: s.isNotNull())))
    g = rows.where(F.col("part").isNotNull()).groupBy("symbol", "rule", "ord").agg(
        F.count(F.when(F.col("part") == "in", 1)).alias("n_in"),
        F.avg(F.when(F.col("part") == "in", F.col("win"))).alias("win_in"),
        F.count(F.when(F.col("part") == "out", 1)).alias("n_out"),
        F.avg(F.when(F.col("part") == "out", F.col("win"))).alias("win_out"),
    )
    pick = (F.col("rule") != hold) & (F.col("n_in") >= 30)
    key = F.when(pick, F.struct("win_in", (-F.col("ord")).alias("o")))
    out = g.groupBy("symbol").agg(
        F.max_by(F.struct("rule", "win_in", "n_out", "win_out"), key).alias("b"),
        F.max(F.when(F.col("rule") == hold, F.col("win_out"))).alias("hold_out"),
    )
    return out.where(F.col("b").isNotNull()).select(
        "symbol",
        F.col("b.rule").alias("best_rule"),
        F.col("b.win_in").alias("win_in_sample"),
        F.when(F.col("b.n_out") >= 15, F.col("b.win_out")).alias("win_out_of_sample"),
        F.col("hold_out").alias("hold_out_of_sample"),
    )


def gap_universe(df: DataFrame) -> DataFrame:
    """Four gap classes pooled over all symbols."""
    from . import regimes as R

    x = R.with_gaps(df).withColumn("__next", w.ret(w.lead("close"), "close"))
    x = x.where(F.col("direction").isNotNull() & F.col("o2c").isNotNull())
    return x.groupBy("direction", "size").agg(
        F.count(F.lit(1)).alias("n"),
        stats.rate(F.col("continued")).alias("continued_rate"),
        stats.rate(F.col("faded")).alias("faded_rate"),
        F.avg("o2c").alias("avg_open_to_close"),
        stats.t_of("o2c").alias("t"),
        F.avg("__next").alias("next_day"),
    )


def extension_episodes(df: DataFrame, levels: Sequence[float] = (0.15, 0.25), h: int = 63) -> DataFrame:
    """Non-overlapping stretches above the 50-bar mean and their paths: return
    and worst drawdown inside ``h`` bars, touch of the mean, the part of the gap
    closed by the price, and the 21 bars after the touch."""
    from . import indicators as I

    x = df.withColumns({"ma": I.sma("close", 50), "i": w.bar_no()})
    f = w.ahead(1, h)
    x = x.withColumns(
        {
            "ext": w.ret("close", "ma"),
            "fwd": w.ret(w.lead("close", h), "close"),
            "fwd21": w.ret(w.lead("close", 21), "close"),
            "worst": w.ret(F.min("close").over(f), "close"),
            "__next": F.collect_list(F.struct("close", "ma")).over(f),
        }
    )
    x = x.withColumn(
        "__path",
        F.transform("__next", lambda b, k: F.when(b["close"] <= b["ma"], F.struct((k + 1).alias("k"), b["close"].alias("c"), b["ma"].alias("m")))),
    )
    touch = F.get(F.filter("__path", lambda b: b.isNotNull()), F.lit(0))
    x = x.withColumn("__t", F.when(F.size("__next") == h, touch))
    closed = w.ratio(F.col("close") - F.col("__t.c"), F.col("close") - F.col("ma"))
    x = x.withColumns({"touch_bar": F.col("__t.k").cast("long"), "price_share": closed})
    cells = [F.when(F.col("ext") >= lv, F.lit(lv)) for lv in levels]
    ev = x.where(F.col("fwd").isNotNull()).withColumn("level", F.explode(F.filter(F.array(*cells), lambda v: v.isNotNull())))
    kept = keep_spaced(ev, ["symbol", "level"], "i", h, ["ts", "i", "fwd", "worst", "touch_bar", "price_share"])
    after = x.select("symbol", F.col("i").alias("__j"), F.col("fwd21").alias("after_touch"))
    kept = kept.join(after, (kept["symbol"] == after["symbol"]) & (F.col("__j") == F.col("i") + F.col("touch_bar")), "left").drop(
        after["symbol"]
    )
    return kept.groupBy("level").agg(
        F.count(F.lit(1)).alias("episodes"),
        F.avg("fwd").alias("mean_fwd"),
        F.avg("worst").alias("mean_worst"),
        F.avg(F.col("touch_bar").isNotNull().cast("double")).alias("touch_rate"),
        F.avg("touch_bar").alias("mean_touch_bar"),
        F.avg("price_share").alias("price_share"),
        F.avg("after_touch").alias("after_touch_21"),
    )
