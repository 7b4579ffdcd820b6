"""Short-horizon forecast: boosted trees on lagged returns, pooled over symbols.

Fitting and scoring are MLlib jobs over all symbols at once.  A forecast rolls
forward in ``h`` driver-side rounds (a loop over steps, never over symbols);
the state of a series is one row with its last bars as two bounded arrays.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions import windows as w
from ..session import cut_lineage
from ..sources import bars as B
from . import evaluations as E
from . import volatility as V

LAGS = 10
Z_MIN, Z_MAX = 1.96, 2.6
MAX_H = 60
FEATURES = [f"ret_lag{k}" for k in range(1, LAGS + 1)] + ["roll_mean5", "roll_std5", "roll_mean10", "mom10"]


def lag_features(df: DataFrame) -> DataFrame:
    """Ten lagged returns and four rolling features, all ending one bar back,
    with the next bar's log return as ``target``."""
    x = df.withColumn("__r", w.ln(w.ratio("close", w.lag("close"))))
    cols = {f"ret_lag{k}": w.lag("__r", k) for k in range(1, LAGS + 1)}
    cols.update(
        {
            "roll_mean5": w.roll(F.avg, "__r", 5, 1),
            "roll_std5": w.roll(F.stddev_samp, "__r", 5, 1),
            "roll_mean10": w.roll(F.avg, "__r", 10, 1),
            "mom10": w.ret(w.lag("close", 1), w.lag("close", 11)),
            "target": w.lead("__r", 1),
        }
    )
    return x.withColumns(cols).withColumn("log_ret", F.col("__r")).drop("__r")


def assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="skip")


def training_rows(df: DataFrame) -> DataFrame:
    """Rows with all features and a target, and ``target_ts``, the date on which the target is known."""
    x = lag_features(df).withColumn("target_ts", w.lead("ts")).dropna(subset=[*FEATURES, "target"])
    return assembler().transform(x)


def known_by(rows: DataFrame, cut: Column) -> DataFrame:
    """Training rows whose target is known on date ``cut``, the same for all symbols.

    The model is pooled: a cut by bar number would let a shorter symbol's rows
    tell of dates after another symbol's origin."""
    return rows.where(F.col("target_ts") <= cut)


def calendar_cut(df: DataFrame, share: float) -> Column:
    """The date that leaves ``share`` of the calendar behind it."""
    cal = B.calendar(df)
    return cal.where(F.col("ci") == F.floor(F.col("cn") * share)).agg(F.max("ts")).scalar()


def fit_gbt(rows: DataFrame, trees: int = 20, step: float = 0.1, seed: int = 42):
    """Pooled boosted trees on the next log return."""
    gbt = GBTRegressor(
        featuresCol="features", labelCol="target", predictionCol="pred", maxIter=trees, maxDepth=3, stepSize=step, subsamplingRate=0.8, seed=seed
    )
    return gbt.fit(rows)


def fit_report(df: DataFrame, split: float = 0.8, trees: int = 20) -> DataFrame:
    """Chronological hold-out error per symbol: RMSE, direction and the
    majority-direction base rate.  One calendar date parts training and test."""
    x, cut = training_rows(df), calendar_cut(df, split)
    model = fit_gbt(known_by(x, cut), trees)
    p = model.transform(x.where(F.col("target_ts") > cut))
    t, y = F.col("target"), F.col("pred")
    up = F.avg((t > 0).cast("double"))
    return p.groupBy("symbol").agg(
        F.count(t).alias("n_test"),
        F.sqrt(F.avg((y - t) ** 2)).alias("rmse"),
        stats.rate(F.signum(y) == F.signum(t)).alias("directional_accuracy"),
        F.greatest(up, 1 - up).alias("baseline_accuracy"),
    )


def adaptive_z(df: DataFrame, h: int, window: int = 504) -> DataFrame:
    """Per symbol: the 95th percentile of standardised h-bar moves over the last
    ``window`` finished ones, clipped; the fixed multiplier below 60 of them."""
    x = E.with_targets(df, h).withColumn("__a", w.bars_ago())
    u = F.when(
        F.col("__a").between(h, h + window - 1) & (F.col("blend") > 0), F.abs(F.col("move") / (F.col("blend") * math.sqrt(h)))
    )
    g = x.groupBy("symbol").agg(
        F.count(u).alias("moves"),
        F.percentile(u, F.lit(0.95)).alias("__q"),
        F.max_by("blend", F.when(F.col("blend").isNotNull(), F.col("ts"))).alias("sigma"),
    )
    return g.select("symbol", "moves", "sigma", F.when(F.col("moves") >= 60, w.clip(F.col("__q"), Z_MIN, Z_MAX)).otherwise(Z_MIN).alias("z"))


def tail_label(z: Column) -> Column:
    return F.when(z >= 2.15, "fat-tailed").when(z >= 2.03, "heavy").otherwise("near-normal")


def band(value: Column, sigma: Column, z: Column, step: Column, resid: Column | float) -> tuple[Column, Column]:
    """Log-space band from the volatility, or a symmetric one from the residual
    when no volatility is known."""
    root = F.sqrt(step.cast("double"))
    r = resid if isinstance(resid, Column) else F.lit(float(resid))
    known = sigma > 0
    lo = F.when(known, value * F.exp(-z * sigma * root)).otherwise(value - Z_MIN * value * r * root)
    hi = F.when(known, value * F.exp(z * sigma * root)).otherwise(value + Z_MIN * value * r * root)
    return lo, hi


def states(df: DataFrame) -> DataFrame:
    """Every bar as a forecast origin: its last returns and closes, newest last,
    plus the volatility known on it."""
    x = V.with_blend(df).withColumn("__r", w.ln(w.ratio("close", w.lag("close"))))
    x = x.withColumns(
        {
            "rets": F.collect_list("__r").over(w.trailing(LAGS + 1)),
            "closes": F.collect_list("close").over(w.trailing(LAGS + 2)),
            "i": w.bar_no(),
            "n": w.n_bars(),
        }
    )
    return x.drop("__r")


def _state_features() -> dict[str, Column]:
    """The features of the bar after the state's newest one: the newest return
    itself is not a lag yet, as in training."""
    r, c = F.col("rets"), F.col("closes")
    n, m = F.size(r), F.size(c)
    lag = lambda k: F.get(r, n - 1 - k)
    last = lambda k: [lag(j) for j in range(1, k + 1)]

    def mean(k: int) -> Column:
        return sum(last(k)[1:], last(k)[0]) / float(k)

    m5 = mean(5)
    var = sum(((x - m5) * (x - m5) for x in last(5)[1:]), (last(5)[0] - m5) * (last(5)[0] - m5)) / 4.0
    cols = {f"ret_lag{k}": lag(k) for k in range(1, LAGS + 1)}
    cols.update(
        {"roll_mean5": m5, "roll_std5": F.sqrt(var), "roll_mean10": mean(10), "mom10": F.get(c, m - 2) / F.get(c, m - 12) - 1.0}
    )
    return {k: F.coalesce(v, F.lit(0.0)) for k, v in cols.items()}


def roll_forward(origin: DataFrame, model, h: int) -> DataFrame:
    """Recursive forecast of every origin row: adds ``path``, an array of ``h``
    values.  Lineage is cut each round, otherwise the plan (and the copies of
    the prediction in it) would double with every step."""
    if not 1 <= h <= MAX_H:
        raise ValueError(f"horizon must lie in 1..{MAX_H}")
    x = origin.withColumn("path", F.array().cast("array<double>"))
    va = assembler()
    for _ in range(h):
        x = x.withColumns(_state_features())
        x = model.transform(va.transform(x)).drop("features", *FEATURES)
        nxt = F.get("closes", F.size("closes") - 1) * F.exp("pred")
        x = x.withColumn("__v", nxt)
        x = x.select(
            *[c for c in x.columns if c not in ("rets", "closes", "path", "pred", "__v")],
            F.concat(F.slice("rets", 2, LAGS), F.array("pred")).alias("rets"),
            F.concat(F.slice("closes", 2, LAGS + 1), F.array("__v")).alias("closes"),
            F.concat("path", F.array("__v")).alias("path"),
        )
        x = cut_lineage(x)
    return x


def points(rolled: DataFrame, z: DataFrame | None = None, resid: DataFrame | None = None) -> DataFrame:
    """(…, step, value, lower, upper) rows of rolled origins; ``resid(symbol,
    rmse)`` is the hold-out error that bands a symbol without a volatility."""
    keep = [c for c in rolled.columns if c not in ("rets", "closes", "path")]
    x = rolled.select(*keep, F.posexplode("path").alias("__p", "value")).withColumn("step", (F.col("__p") + 1).cast("long")).drop("__p")
    x = x.join(z.select("symbol", "z"), "symbol", "left") if z is not None else x.withColumn("z", F.lit(Z_MIN))
    x = x.join(resid.select("symbol", "rmse"), "symbol", "left") if resid is not None else x.withColumn("rmse", F.lit(None).cast("double"))
    lo, hi = band(F.col("value"), F.col("sigma"), F.coalesce("z", F.lit(Z_MIN)), F.col("step"), F.col("rmse"))
    return x.withColumns({"lower": lo, "upper": hi}).drop("rmse")


def future_dates(bars: DataFrame, h: int, interval: str = "1d") -> DataFrame:
    """The next ``h`` bar dates per symbol: business days for daily bars, +7 or
    +30 days for weekly and monthly ones, else the median spacing."""
    last = bars.groupBy("symbol").agg(F.max("ts").alias("last"))
    if interval == "1d":
        days = F.sequence(F.date_add("last", 1), F.date_add("last", 2 * h + 6))
        open_days = F.slice(F.filter(days, lambda d: F.weekday(d) < 5), 1, h)
        return last.select("symbol", F.posexplode(open_days).alias("p", "d")).select(
            "symbol", (F.col("p") + 1).cast("long").alias("step"), F.col("d").cast("timestamp").alias("ts")
        )
    fixed = {"1wk": 7.0, "1mo": 30.0}.get(interval)
    if fixed is None:
        gap = (F.unix_micros("ts") - F.unix_micros(w.lag("ts"))) / 86400e6
        sp = bars.select("symbol", gap.alias("g")).groupBy("symbol").agg(F.percentile("g", F.lit(0.5)).alias("s"))
        last = last.join(sp, "symbol").withColumn("s", F.coalesce("s", F.lit(1.0)))
    else:
        last = last.withColumn("s", F.lit(fixed))
    x = last.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(h).cast("long"))).alias("step"))
    micros = F.unix_micros("last") + F.round(F.col("s") * F.col("step") * 86400e6).cast("long")
    return x.select("symbol", "step", F.timestamp_micros(micros).alias("ts"))


def forecast(df: DataFrame, h: int = 10, trees: int = 20) -> DataFrame:
    """Recursive forecast from the newest bar of every symbol with its band."""
    model = fit_gbt(training_rows(df), trees)
    error = fit_report(df, trees=trees).select("symbol", "rmse")
    origin = states(df).where((F.col("i") == F.col("n") - 1) & (F.col("n") >= LAGS + 40)).select("symbol", "sigma", "rets", "closes", F.col("close").alias("entry"))
    p = points(roll_forward(origin, model, h), adaptive_z(df, h), error)
    return p.join(future_dates(df, h), ["symbol", "step"]).select(
        "symbol", "step", "ts", "entry", "value", "lower", "upper", "z", tail_label(F.col("z")).alias("tail")
    )


def persistence(df: DataFrame, h: int) -> DataFrame:
    """The last value as forecast: its absolute relative error at ``h`` bars."""
    nxt = w.lead("close", h)
    x = df.select("symbol", F.abs(F.col("close") - nxt).alias("__e"), nxt.alias("__a")).where(F.col("__a").isNotNull())
    return x.groupBy("symbol").agg(F.count("__e").alias("n"), F.avg(F.col("__e") / F.col("__a")).alias("naive_mae"))


def track_record(df: DataFrame, h: int = 10, tests: int = 40, refit: int = 8, trees: int = 10) -> DataFrame:
    """Walk-forward direction record over the last ``tests`` dates that have
    ``h`` more: each block of ``refit`` dates is scored by a model of what was
    known on its first date."""
    x = B.with_calendar(lag_features(df)).withColumns({"n": w.n_bars(), "__f": w.lead("close", h), "__tc": w.lead("ci")})
    base = F.col("cn") - tests - h
    x = x.where(F.col("n") >= 150 + h).withColumns({"j": F.col("ci") - base, "jt": F.col("__tc") - base})
    rows = assembler().transform(x.dropna(subset=FEATURES))
    out = None
    for start in range(0, tests, refit):
        model = fit_gbt(rows.where((F.col("jt") <= start) & F.col("target").isNotNull()), trees)
        part = model.transform(rows.where(F.col("j").between(start, start + refit - 1)))
        part = part.select("symbol", "j", F.signum("pred").alias("p"), F.signum(F.col("__f") - F.col("close")).alias("a"))
        out = part if out is None else out.unionByName(part)
    t = out.where(F.col("a") != 0)
    p, a = F.col("p"), F.col("a")
    up = F.avg((a > 0).cast("double"))
    g = t.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("tries"),
        stats.rate(p == a).alias("hit_rate"),
        F.greatest(up, 1 - up).alias("majority_baseline"),
        F.count(F.when(p > 0, 1)).alias("up_calls"),
        F.avg(F.when(p > 0, (a > 0).cast("double"))).alias("up_accuracy"),
        F.count(F.when(p < 0, 1)).alias("down_calls"),
        F.avg(F.when(p < 0, (a < 0).cast("double"))).alias("down_accuracy"),
    )
    edge = F.col("hit_rate") - F.col("majority_baseline")
    return g.withColumn("verdict", F.when(edge > 0.03, "beats_baseline").when(edge < -0.03, "worse").otherwise("same"))


def _scored(df: DataFrame, origins: DataFrame, model, h: int, z: DataFrame | None = None) -> DataFrame:
    """Points of many origins joined with what happened ``step`` bars later."""
    p = points(roll_forward(origins, model, h), z)
    actual = df.select("symbol", w.bar_no().alias("__j"), F.col("close").alias("actual"), F.col("ts").alias("actual_ts"), F.col("high").alias("actual_high"))
    return p.withColumn("__j", F.col("i") + F.col("step")).join(actual, ["symbol", "__j"]).drop("__j")


def _rates() -> list[Column]:
    v, a, e = F.col("value"), F.col("actual"), F.col("entry")
    up = F.avg((a > e).cast("double"))
    return [
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(v - a) / a).alias("model_mae"),
        F.avg(F.abs(e - a) / a).alias("naive_mae"),
        stats.rate(F.signum(v - e) == F.signum(a - e)).alias("direction"),
        F.greatest(up, 1 - up).alias("direction_baseline"),
        stats.rate((a >= F.col("lower")) & (a <= F.col("upper"))).alias("band_cover"),
    ]


def _origins(df: DataFrame) -> DataFrame:
    return states(df).select("symbol", "ts", "i", "n", F.col("close").alias("entry"), "sigma", "rets", "closes").where(F.col("i") >= 260)


def walkforward_eval(df: DataFrame, lookback: int = 120, h: int = 5, trees: int = 20, refit: int = 40) -> DataFrame:
    """Forecast error, direction and band cover at 1 and ``h`` bars over the last
    ``lookback`` dates; each block of ``refit`` dates has a model of what was
    known on its first date."""
    cal = B.calendar(df).withColumn("j", F.col("ci") - (F.col("cn") - lookback))
    rows = training_rows(df)
    origins = _origins(df).where(F.col("i") < F.col("n") - h).join(cal.select("ts", "j"), "ts").where("j >= 0")
    s = None
    for start in range(0, lookback, refit):
        cut = cal.where(F.col("j") == start).agg(F.max("ts")).scalar()
        model = fit_gbt(known_by(rows, cut), trees)
        part = _scored(df, origins.where(F.col("j").between(start, start + refit - 1)), model, h)
        s = part if s is None else s.unionByName(part)
    return s.where(F.col("step").isin(1, h)).groupBy(F.col("step").alias("horizon")).agg(*_rates())


def holdout_eval(df: DataFrame, cutoff: str, n: int = 2, trees: int = 20) -> DataFrame:
    """Train through ``cutoff``, compare the next ``n`` bars of every symbol."""
    cut = F.lit(cutoff).cast("timestamp")
    train = df.where(F.col("ts") <= cut)
    model = fit_gbt(training_rows(train), trees)
    o = _origins(train).where(F.col("i") == F.col("n") - 1)
    s = _scored(df, o, model, n, adaptive_z(train, n))
    hit = F.signum(F.col("value") - F.col("entry")) == F.signum(F.col("actual") - F.col("entry"))
    return s.select(
        "symbol", "step", "actual_ts", "entry", "value", "lower", "upper", "actual", hit.alias("direction_ok"), F.col("actual").between(F.col("lower"), F.col("upper")).alias("in_band")
    )


def _week_starts(df: DataFrame) -> DataFrame:
    """First bar and bar count of every ISO week per symbol."""
    wk = F.struct(F.extract(F.lit("YEAROFWEEK"), F.col("ts")).alias("y"), F.weekofyear("ts").alias("wk"))
    x = df.select("symbol", "ts", w.bar_no().alias("j"), wk.alias("week"))
    return x.groupBy("symbol", "week").agg(F.min("j").alias("first"), F.count(F.lit(1)).alias("days"), F.min("ts").alias("first_ts"))


def month_oos_eval(df: DataFrame, month: str, trees: int = 20, h: int = 31) -> DataFrame:
    """One month out of sample, per ISO week and as a whole: direction at the
    last bar, band cover, and whether the plan's target was reached.  The month
    counts each symbol from its last bar before it; the model sees only bars
    before the month."""
    from . import tradeplan as TP

    first = F.to_date(F.lit(f"{month}-01")).cast("timestamp")
    train = df.where(F.col("ts") < first)
    model = fit_gbt(training_rows(train), trees)
    inside = df.withColumn("j", w.bar_no()).where(F.date_format("ts", "yyyy-MM") == month)
    weeks = inside.groupBy("symbol", F.weekofyear("ts").alias("wk")).agg(F.min("j").alias("a"), F.max("j").alias("b"), F.max("high").alias("top"))
    whole = inside.groupBy("symbol").agg(F.min("j").alias("a"), F.max("j").alias("b"), F.max("high").alias("top"))
    spans = weeks.select("symbol", F.lit("week").alias("span"), "a", "b", "top").unionByName(whole.select("symbol", F.lit("month").alias("span"), "a", "b", "top"))
    spans = spans.withColumns({"i": F.col("a") - 1, "steps": F.col("b") - F.col("a") + 1}).where("i >= 260")
    o = _origins(df).join(spans.select("symbol", "i").distinct(), ["symbol", "i"], "left_semi")
    s = _scored(df, o, model, h)
    j = s.join(spans, ["symbol", "i"]).where(F.col("step") == F.col("steps"))
    plans = None
    for span, hh in (("week", 5), ("month", 21)):
        p = TP.plan_series(df, hh).select("symbol", "i", F.lit(span).alias("span"), "target")
        plans = p if plans is None else plans.unionByName(p)
    j = j.join(plans, ["symbol", "i", "span"], "left")
    return j.groupBy("span").agg(*_rates(), stats.rate(F.col("top") >= F.col("target")).alias("target_reached"))


def weekly_direction_eval(df: DataFrame, weeks: int = 10, trees: int = 20, refit: int = 5) -> DataFrame:
    """First-bar and all-bar direction, band cover and error of the last
    ``weeks`` ISO weeks, forecast from the bar before each week; each block of
    ``refit`` weeks has a model of the dates before it."""
    ws = _week_starts(df)
    last = ws.groupBy("week").agg(F.min("first_ts").alias("opens")).orderBy(F.desc("week")).limit(weeks)
    order = sorted(last.collect(), key=lambda r: r.opens)  # at most ``weeks`` rows
    ws = ws.join(F.broadcast(last), "week").withColumn("i", F.col("first") - 1).where("i >= 260")
    rows, origins, s = training_rows(df), _origins(df), None
    for k in range(0, len(order), refit):
        block = order[k : k + refit]
        model = fit_gbt(rows.where(F.col("target_ts") < F.lit(block[0].opens)), trees)
        own = ws.where(F.col("opens").between(block[0].opens, block[-1].opens)).select("symbol", "i")
        part = _scored(df, origins.join(own, ["symbol", "i"], "left_semi"), model, 5)
        s = part if s is None else s.unionByName(part)
    s = s.join(ws.select("symbol", "i", "days"), ["symbol", "i"]).where(F.col("step") <= F.col("days"))
    ok = F.signum(F.col("value") - F.col("entry")) == F.signum(F.col("actual") - F.col("entry"))
    return s.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(F.col("step") == 1, ok.cast("double"))).alias("first_day_direction"),
        F.avg(ok.cast("double")).alias("all_day_direction"),
        stats.rate(F.col("actual").between(F.col("lower"), F.col("upper"))).alias("band_cover"),
        F.avg(F.abs(F.col("value") - F.col("actual")) / F.col("actual")).alias("mae"),
    )
