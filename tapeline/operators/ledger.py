"""The signal ledger: extraction, exactly-once logging, forward scoring.

Append-only: scores are derived from bars each time, never written back, so
there is no update in place and scoring is idempotent by construction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas, session
from ..functions import stats
from ..functions import windows as w
from ..sources import snapshots
from . import joins

HORIZONS = (5, 21, 63)
KEY = ["ts", "symbol", "signal_type"]
# fixed values: bands of predicted probability; the last one is closed at 1
BANDS = [(0.0, 0.5, "0-50%"), (0.5, 0.6, "50-60%"), (0.6, 0.7, "60-70%"), (0.7, 0.8, "70-80%"), (0.8, 1.01, "80-100%")]


def extract_signals(verdicts: DataFrame) -> DataFrame:
    """Directional calls of verdict rows (latest or per bar).

    Reads ts, symbol, price, state, p_reach_ath_63d, dip_active,
    pattern_direction, p_up, tilt_pp, hot_runup, crossover_direction,
    conviction_direction; a missing column means no such call."""
    have = set(verdicts.columns)

    def c(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)

    def call(kind: str, cond: Column, direction: Column, p: Column, note: Column) -> Column:
        return F.when(
            w.flag(cond),
            F.struct(
                F.lit(kind).alias("signal_type"), direction.alias("direction"), p.cast("double").alias("predicted_p"), note.cast("string").alias("note")
            ),
        )

    none = F.lit(None)
    pat, cross, conv = c("pattern_direction", "string"), c("crossover_direction", "string"), c("conviction_direction", "string")
    calls = [
        call("resistance_breakout", c("state", "string") == "fresh_breakout", F.lit("up"), c("p_reach_ath_63d", "double"), c("state", "string")),
        call("dip_buy", c("dip_active", "boolean"), F.lit("up"), none, none),
        call("pattern_tilt", pat.isin("BULLISH", "BEARISH"), F.when(pat == "BULLISH", "up").otherwise("down"), c("p_up", "double"), F.concat(F.round(c("tilt_pp", "double"), 1).cast("string"), F.lit("pp"))),
        call("earnings_runup", c("hot_runup", "boolean"), F.lit("down"), none, none),
        call("ema_macd_crossover", cross.isin("up", "down"), cross, none, none),
        call("conviction_stack", conv.isin("up", "down"), conv, none, none),
    ]
    v = verdicts.where(F.col("price").isNotNull())
    return v.select(
        F.date_trunc("day", "ts").alias("ts"),
        F.upper("symbol").alias("symbol"),
        F.col("price").alias("entry_price"),
        F.inline(F.filter(F.array(*calls), lambda s: s.isNotNull())),
    ).select(*schemas.LEDGER.fieldNames())


def verdict_frame(bars: DataFrame, resistance: DataFrame, dip: DataFrame, pattern: DataFrame, runup: DataFrame, crossover: DataFrame, conviction: DataFrame) -> DataFrame:
    """The newest verdicts of every symbol side by side, as ``extract_signals`` reads them; each input has a row per symbol."""
    now = bars.groupBy("symbol").agg(F.max("ts").alias("ts"), F.max_by("close", "ts").alias("price"))
    for other in (
        resistance.select("symbol", "state", "p_reach_ath_63d"),
        dip.select("symbol", F.col("active").alias("dip_active")),
        pattern.select("symbol", F.col("direction").alias("pattern_direction"), "p_up", "tilt_pp"),
        runup.select("symbol", "hot_runup"),
        crossover.select("symbol", F.col("direction").alias("crossover_direction")),
        conviction.select("symbol", F.col("direction").alias("conviction_direction")),
    ):
        now = now.join(other, "symbol", "left")
    return now


def log_signals(new: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """The rows to append: one per (day, symbol, type) and none already logged."""
    rest = [c for c in new.columns if c not in KEY]
    one = new.groupBy(*KEY).agg(F.min(F.struct(*rest)).alias("__r")).select(*KEY, "__r.*").select(*new.columns)
    return one if ledger is None else one.join(ledger.select(*KEY), KEY, "left_anti")


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def append(new: DataFrame, path: str) -> None:
    """Append to the ledger table at ``path``, one folder per month, exactly once per key.

    The months that get rows are put together with what they hold, staged in the
    shared folder, and replace their folders; a repeated or retried call writes
    the same rows again.  Only a missing path counts as an empty ledger, any
    other failure to read is an error.  One writer at a time."""
    spark = new.sparkSession
    fields = schemas.LEDGER.fieldNames()
    fresh = new.select(*fields).withColumn("month", F.date_format("ts", "yyyy-MM"))
    if _exists(spark, path):
        months = [r.month for r in fresh.select("month").distinct().collect()]
        old = spark.read.schema(schemas.LEDGER).option("basePath", path).parquet(path).withColumn("month", F.date_format("ts", "yyyy-MM"))
        old = old.where(F.col("month").isin(months))
        fresh = old.select(*fields, "month").unionByName(log_signals(new.select(*fields), old.select(*fields)).withColumn("month", F.date_format("ts", "yyyy-MM")))
    else:
        fresh = log_signals(new.select(*fields)).withColumn("month", F.date_format("ts", "yyyy-MM"))
    staged = session.as_table(fresh, "ledger_months")
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def append_published(new: DataFrame, path: str, tries: int = 3) -> int:
    """Append to a published ledger, exactly once per key, and give the snapshot's number.

    The months that get rows are staged with what they hold; one manifest publishes them together, so no crash loses or
    halves a month.  A writer that finds another one's snapshot reads again, ``tries`` times in all."""
    spark, fields = new.sparkSession, schemas.LEDGER.fieldNames()
    month = F.date_format("ts", "yyyy-MM")
    fresh = session.as_table(log_signals(new.select(*fields)), "ledger_calls")
    months = [r.month for r in fresh.select(month.alias("month")).distinct().collect()]
    for k in range(tries):
        seen, parts = snapshots.current(spark, path)
        old = snapshots.read(spark, path, schemas.LEDGER, months)
        staged = snapshots.stage(old.unionByName(log_signals(fresh, old)), path, month)
        try:
            return snapshots.publish(spark, path, seen, parts | staged)
        except snapshots.Conflict:
            if k + 1 == tries:
                raise
    raise ValueError("no try was allowed")


def read_published(spark, path: str) -> DataFrame:
    return snapshots.read(spark, path, schemas.LEDGER)


def score_forward(ledger: DataFrame, bars: DataFrame, benchmark: DataFrame, horizons=HORIZONS) -> DataFrame:
    """Signals with ret_h and bench_h: entry at the first close on or after the
    signal day, exit h bars later, NULL until matured.

    ``lead`` puts every exit on the entry bar, so one as-of lookup per signal is
    the only join; the benchmark is looked up once per distinct day."""
    def exits(df: DataFrame, prefix: str) -> DataFrame:
        return df.withColumns({f"{prefix}_{h}": w.ret(w.lead("close", h), "close") for h in horizons})

    own = exits(bars.select("symbol", "ts", "close"), "ret").withColumnRenamed("close", "entry_close")
    names = ["entry_close", *[f"ret_{h}" for h in horizons]]
    x = joins.asof_forward(ledger, own, ["symbol"], names).drop("match_ts")
    m = exits(benchmark.withColumn("symbol", F.lit("benchmark")), "bench")
    days = ledger.select("ts").distinct().withColumn("symbol", F.lit("benchmark"))
    b = joins.asof_forward(days, m, ["symbol"], [f"bench_{h}" for h in horizons], unit="year").drop("symbol", "match_ts")
    x = x.join(b, "ts", "left")
    # a benchmark return counts only beside a matured own return
    for h in horizons:
        x = x.withColumn(f"bench_{h}", F.when(F.col(f"ret_{h}").isNotNull(), F.col(f"bench_{h}")))
    return x


def type_scoreboard(scored: DataFrame, h: int = 21) -> DataFrame:
    """Direction-adjusted win rate and return; edge only where a benchmark exists."""
    sign = F.when(F.col("direction") == "down", -1.0).otherwise(1.0)
    r = F.col(f"ret_{h}") * sign
    e = (F.col(f"ret_{h}") - F.col(f"bench_{h}")) * sign
    g = scored.groupBy("signal_type").agg(
        F.count(r).alias("n"),
        stats.rate(r > 0).alias("win_rate"),
        F.avg(r).alias("avg_dir_return"),
        F.avg(e).alias("avg_edge"),
        F.count(e).alias("n_benchmarked"),
    )
    return g.where(F.col("n") > 0)


def calibration_curve(scored: DataFrame, h: int = 21, min_n: int = 5) -> DataFrame:
    """Realised up-rate per band of predicted probability at horizon ``h``; pass
    the horizon the probability was measured at for a matched curve."""
    p = F.col("predicted_p")
    band = None
    for lo, hi, label in BANDS:
        cond = (p >= lo) & (p < hi)
        band = F.when(cond, label) if band is None else band.when(cond, label)
    x = scored.where(F.col(f"ret_{h}").isNotNull()).withColumn("band", band).where(F.col("band").isNotNull())
    g = x.groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), F.avg("predicted_p").alias("mean_predicted"), stats.rate(F.col(f"ret_{h}") > 0).alias("realized_up_rate")
    )
    return g.where(F.col("n") >= min_n)


def recent(ledger: DataFrame, limit: int = 50) -> DataFrame:
    return ledger.orderBy(F.desc("ts"), "symbol", "signal_type").limit(limit)


def latest_per_type(ledger: DataFrame, k: int = 3) -> DataFrame:
    spec = Window.partitionBy("signal_type").orderBy(F.desc("ts"), "symbol")
    return ledger.withColumn("pos", F.row_number().over(spec).cast("long")).where(F.col("pos") <= k)
