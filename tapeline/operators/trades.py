"""Position rules and trade replays.

Sequential logic is reduced to candidate entries first.  A trade's exit lies
within a bounded frame after its entry, so it is a column of the entry row;
what remains is picking non-overlapping trades, a fold over one symbol's
entries (bounded by its bars).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import session
from ..functions import stats
from ..functions import windows as w
from . import indicators as I

DIP_RSI = 15
TARGET = 0.06
STOP = -0.08
MAX_BARS = 12
WARM = 210
MIN_TRADES = 15


def position_walk(df: DataFrame, entry: Column, exit_: Column, out: str = "pos") -> DataFrame:
    """0/1 state from the prior bar's signals.

    A bar with exactly one signal sets the state; a bar with both flips it.  So
    the state is the last one-signal bar, flipped by the parity of both-signal
    bars since: two running windows, no fold."""
    keep = df.columns
    x = df.withColumns({"__e0": w.flag(entry), "__x0": w.flag(exit_)})
    x = x.withColumns({"__e": F.coalesce(w.lag("__e0"), F.lit(False)), "__x": F.coalesce(w.lag("__x0"), F.lit(False))})
    single = F.col("__e") != F.col("__x")
    both = F.col("__e") & F.col("__x")
    h = w.history()
    x = x.withColumn("__t", F.sum(both.cast("int")).over(h))
    x = x.withColumns(
        {
            "__base": F.coalesce(F.last(F.when(single, F.col("__e").cast("int")), ignorenulls=True).over(h), F.lit(0)),
            "__t0": F.coalesce(F.last(F.when(single, F.col("__t")), ignorenulls=True).over(h), F.lit(0)),
        }
    )
    state = (F.col("__base") + F.col("__t") - F.col("__t0")) % 2
    return x.withColumn(out, state.cast("double")).select(*keep, out)


def with_exit(df: DataFrame) -> DataFrame:
    """For an entry at each bar: bars held until the first exit and its return;
    NULL while no exit has happened yet."""
    nxt = F.collect_list(F.struct("close", (F.col("close") > F.col("sma5")).alias("over"))).over(w.ahead(1, MAX_BARS))
    x = df.withColumn("__next", nxt)
    c = F.col("close")
    exits = F.transform(
        "__next",
        lambda b, k: F.when(
            w.flag(b["over"]) | (b["close"] / c - 1 >= TARGET) | (b["close"] / c - 1 <= STOP) | (k == MAX_BARS - 1),
            F.struct((k + 1).cast("long").alias("held"), (b["close"] / c - 1).alias("ret")),
        ),
    )
    first = F.get(F.filter(exits, lambda e: e.isNotNull()), F.lit(0))
    return x.withColumn("__exit", first).withColumns({"held": F.col("__exit.held"), "ret": F.col("__exit.ret")}).drop("__next", "__exit")


def non_overlapping(entries: DataFrame) -> DataFrame:
    """Greedy pick per symbol: the next entry must come after the last exit; an
    entry still open at the end blocks later ones and is not reported.

    An entry after the exits of all earlier candidates is taken whatever came
    before: such entries begin islands, and each island is folded alone."""
    order = Window.partitionBy("symbol").orderBy("i")
    exits = F.coalesce(F.col("i") + F.col("held"), F.lit(2**62))
    x = entries.withColumn("__past", F.max(exits).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    x = x.withColumn("__island", F.sum((F.col("i") > F.col("__past")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    e = x.groupBy("symbol", F.coalesce("__island", F.lit(0)).alias("__island")).agg(F.array_sort(F.collect_list(F.struct("i", "held", "ret"))).alias("__e"))
    zero = F.struct(
        F.lit(-1).cast("long").alias("free"),
        F.array().cast("array<struct<i:bigint,held:bigint,ret:double>>").alias("done"),
    )

    def step(acc: Column, x: Column) -> Column:
        take = x["i"] > acc["free"]
        blocked = F.lit(2**62).cast("long")
        end = F.coalesce(x["i"] + x["held"], blocked)
        row = F.struct(x["i"].alias("i"), x["held"].alias("held"), x["ret"].alias("ret"))
        done = F.when(take & x["held"].isNotNull(), F.concat(acc["done"], F.array(row))).otherwise(acc["done"])
        return F.struct(F.when(take, end).otherwise(acc["free"]).alias("free"), done.alias("done"))

    return e.withColumn("__f", F.aggregate("__e", zero, step)).select("symbol", F.inline("__f.done"))


def _prepared(df: DataFrame) -> DataFrame:
    x = I.rsi(df, "rsi2", 2, "ewm").withColumns(
        {"sma5": I.sma("close", 5), "sma200": I.sma("close", 200), "i": w.bar_no(), "n": w.n_bars()}
    )
    dip = w.flag((F.col("rsi2") < DIP_RSI) & (F.col("close") > F.col("sma200")))
    return session.keep(with_exit(x.withColumn("dip", dip & (F.col("i") >= WARM))))


def dip_trades(df: DataFrame) -> DataFrame:
    """Trades of the dip rule: enter the bar after the signal, leave on a close
    over the 5-bar mean, the target, the stop or after 12 bars."""
    return non_overlapping(dip_entries(df))


def dip_entries(df: DataFrame) -> DataFrame:
    """Every bar the dip rule would enter on, with its exit: symbol, i, held, ret."""
    x = _prepared(df)
    x = x.withColumn("__go", F.coalesce(w.lag("dip"), F.lit(False)))
    return x.where("__go").select("symbol", "i", "held", "ret")


def random_entry_control(df: DataFrame, seed: str = "0") -> DataFrame:
    """As many control entries per symbol as there were dip signals, drawn in
    hash order, through the same exits."""
    x = _prepared(df)
    want = F.sum(F.col("dip").cast("int")).over(w.whole())
    order = F.md5(F.concat_ws("|", "symbol", F.date_format("ts", "yyyy-MM-dd"), F.lit(seed)))
    x = x.withColumns({"__want": want, "__h": order})
    ok = (F.col("i") >= WARM) & (F.col("i") < F.col("n") - 1)
    rank = F.row_number().over(Window.partitionBy("symbol", ok).orderBy("__h"))
    x = x.withColumn("__pick", ok & (rank <= F.col("__want"))).withColumn("__go", F.coalesce(w.lag("__pick"), F.lit(False)))
    return non_overlapping(x.where("__go").select("symbol", "i", "held", "ret"))


def trade_metrics(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Count, win rate, mean return and profit factor (NULL without losses)."""
    r = F.col("ret")
    wins, losses = F.sum(F.when(r > 0, r)), F.sum(F.when(r <= 0, r))
    return trades.groupBy(*keys).agg(
        F.count(r).alias("n"),
        stats.rate(r > 0).alias("win_rate"),
        F.avg(r).alias("avg_ret"),
        F.when(losses < 0, F.coalesce(wins, F.lit(0.0)) / -losses).alias("profit_factor"),
    )


def entry_edge(df: DataFrame) -> DataFrame:
    """Dip entries against the random control, pooled: rates and z."""
    a, b = dip_trades(df), random_entry_control(df)
    u = a.select(F.lit(1).alias("d"), "ret").unionByName(b.select(F.lit(0).alias("d"), "ret"))
    d = F.col("d") == 1
    win = (F.col("ret") > 0).cast("double")
    g = u.agg(
        F.count(F.when(d, 1)).alias("n_rule"),
        F.avg(F.when(d, win)).alias("win_rule"),
        F.avg(F.when(d, F.col("ret"))).alias("avg_rule"),
        F.count(F.when(~d, 1)).alias("n_random"),
        F.avg(F.when(~d, win)).alias("win_random"),
        F.avg(F.when(~d, F.col("ret"))).alias("avg_random"),
    )
    return g.withColumn(
        "z", stats.z_two_proportions(F.col("win_rule"), F.col("n_rule"), F.col("win_random"), F.col("n_random"))
    )


def dip_state(df: DataFrame) -> DataFrame:
    """The symbol's own dip record, whether a dip is live, and its plan."""
    x = _prepared(df).withColumn("__a", w.bars_ago())
    now = x.groupBy("symbol").agg(
        F.count("close").alias("__n"),
        *[F.max(F.when(F.col("__a") == 0, F.col(c))).alias(a) for c, a in (("close", "price"), ("rsi2", "rsi2"), ("sma200", "__m"))],
    ).where(F.col("__n") >= 260)
    r = F.col("ret")
    own = (
        dip_trades(df)
        .groupBy("symbol")
        .agg(
            F.count(r).alias("n_trades"),
            stats.rate(r > 0).alias("win_rate"),
            F.avg(r).alias("avg_per_trade"),
            F.coalesce(F.percentile(F.when(r > 0, r), F.lit(0.5)), F.lit(0.02)).alias("typical_bounce"),
        )
        .where(F.col("n_trades") >= MIN_TRADES)
    )
    up = F.col("price") > F.col("__m")
    live = w.flag((F.col("rsi2") < DIP_RSI) & up)
    return now.join(own, "symbol").select(
        "symbol",
        "price",
        "rsi2",
        live.alias("active"),
        w.flag(up).alias("in_uptrend"),
        "n_trades",
        "win_rate",
        "avg_per_trade",
        "typical_bounce",
        F.when(live, F.col("price") * (1 + F.col("typical_bounce"))).alias("target"),
        F.when(live, F.col("price") * (1 + STOP)).alias("stop"),
    )


def strategy_states(df: DataFrame) -> DataFrame:
    """In-market columns of five rules, each acting on the prior bar."""
    x = I.rsi(df, "rsi2", 2, "ewm").withColumns(
        {
            **{f"sma{n}": I.sma("close", n) for n in (5, 50, 200)},
            "hi50": w.roll(F.max, "close", 50, 1),
            "lo50": w.roll(F.min, "close", 50, 1),
            "r": w.ret("close", w.lag("close")),
        }
    )
    c = F.col("close")
    x = x.withColumns({"__a": w.flag(c > F.col("sma200")), "__b": w.flag(F.col("sma50") > F.col("sma200"))})
    x = x.withColumns(
        {
            "hold": F.lit(1.0),
            "filter200": F.coalesce(w.lag("__a"), F.lit(False)).cast("double"),
            "golden": F.coalesce(w.lag("__b"), F.lit(False)).cast("double"),
        }
    )
    x = position_walk(x, c > F.col("hi50"), c < F.col("lo50"), "channel")
    return position_walk(x, (F.col("rsi2") < 10) & (c > F.col("sma200")), c > F.col("sma5"), "rsi2_dip")


RULES = ["hold", "filter200", "golden", "channel", "rsi2_dip"]


def equity_stats(rows: DataFrame, keys: list[str], r: str = "sr", exposure: str = "pos") -> DataFrame:
    """Total return, worst drawdown, Sharpe and exposure of ordered returns."""
    spec = Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    x = rows.withColumn("__eq", I.compounded(F.coalesce(F.col(r), F.lit(0.0)), spec))
    x = x.withColumn("__dd", F.col("__eq") / F.max("__eq").over(spec) - 1.0)
    z = F.coalesce(F.col(r), F.lit(0.0))
    return x.groupBy(*keys).agg(
        (F.max_by("__eq", "ts") - 1.0).alias("total_return"),
        F.min("__dd").alias("max_drawdown"),
        (F.avg(z) / (F.stddev_samp(z) + 1e-12) * math.sqrt(252)).alias("sharpe"),
        F.avg(exposure).alias("exposure"),
    )


def strategy_lab(df: DataFrame, keep: int = 252) -> DataFrame:
    """Five rules scored over the last ``keep`` bars against holding."""
    x = strategy_states(df).withColumns({"__a": w.bars_ago(), "__n": w.n_bars()})
    x = x.where((F.col("__a") < keep) & (F.col("__n") >= 260))
    rows = x.unpivot(["symbol", "ts", "r"], RULES, "rule", "pos").withColumn("sr", F.col("r") * F.col("pos"))
    g = equity_stats(rows, ["symbol", "rule"])
    held = Window.partitionBy("symbol")
    ref = lambda c: F.max(F.when(F.col("rule") == "hold", F.col(c))).over(held)
    g = g.withColumns({"__r": ref("total_return"), "__d": ref("max_drawdown"), "__s": ref("sharpe")})
    dd = F.col("max_drawdown") > F.col("__d") + 0.02
    rt = F.col("total_return") > F.col("__r")
    sh = F.col("sharpe") > F.col("__s") + 0.05
    verdict = (
        F.when(F.col("rule") == "hold", "benchmark")
        .when(rt & dd, "beats_both")
        .when(sh & dd, "better_risk_adjusted")
        .when(dd & ~rt, "safer")
        .when(rt, "higher_return")
        .otherwise("loses")
    )
    return g.withColumn("verdict", verdict).drop("__r", "__d", "__s")


def timing_study(df: DataFrame) -> DataFrame:
    """200-bar filter against holding on simple returns over the full history:
    return, annual volatility, drawdown, Sharpe."""
    x = df.withColumns({"r": w.ret("close", w.lag("close")), "__m": I.sma("close", 200)})
    x = x.withColumn("__a", w.flag(F.col("close") > F.col("__m")))
    x = x.withColumns({"hold": F.lit(1.0), "filter200": F.coalesce(w.lag("__a"), F.lit(False)).cast("double")})
    rows = x.where(F.col("r").isNotNull()).unpivot(["symbol", "ts", "r"], ["hold", "filter200"], "rule", "pos")
    rows = rows.withColumn("sr", F.col("r") * F.col("pos"))
    vol = rows.groupBy("symbol", "rule").agg((F.stddev_samp("sr") * math.sqrt(252)).alias("annual_vol"))
    return equity_stats(rows, ["symbol", "rule"]).join(vol, ["symbol", "rule"])
