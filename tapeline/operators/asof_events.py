"""Signals as they stood on past bars: the newest few events and their record so far.

Events carry an ordinal per symbol, so "the newest three as of bar t" is an
equi-join on (symbol, ordinal) and no frame is gathered.  What was known of a
pattern by bar t is a running sum over occurrences, outcomes (placed on the bar
that made them known) and questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as w

#: Rows of one bar are read outcomes first, questions last.
_PAST = Window.unboundedPreceding


def newest_events(asked: DataFrame, events: DataFrame, k: int, within: int) -> DataFrame:
    """``asked(symbol, i)`` x the newest ``k`` ``events(symbol, i, rank, ...)`` of the last ``within`` bars.

    Ties on a bar follow ``rank``.  Gives (symbol, t, pos, i, rank, ...), pos 0 is the newest."""
    e = events.withColumn("__no", F.row_number().over(Window.partitionBy("symbol").orderBy("i", F.desc("rank"))))
    marks = e.groupBy("symbol", "i").agg(F.max("__no").alias("__upto")).withColumn("__ask", F.lit(0))
    rows = marks.unionByName(asked.select("symbol", "i", F.lit(None).cast("int").alias("__upto"), F.lit(1).alias("__ask")))
    order = Window.partitionBy("symbol").orderBy("i", "__ask").rowsBetween(_PAST, 0)
    at = rows.withColumn("__upto", F.last("__upto", ignorenulls=True).over(order)).where("__ask = 1 AND __upto IS NOT NULL")
    at = at.select("symbol", F.col("i").alias("t"), "__upto", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("pos"))
    return at.withColumn("__no", F.col("__upto") - F.col("pos")).join(e, ["symbol", "__no"]).where(F.col("t") - F.col("i") < within).drop("__no", "__upto")


def record_so_far(asked: DataFrame, events: DataFrame, keys: list[str], h: int) -> DataFrame:
    """``asked(*keys, t, ...)`` with what its pattern had shown by bar t: occurrences, samples and wins after ``h`` bars.

    ``events(*keys, i, won)``: ``won`` is known on bar i + h, NULL where that bar does not exist."""
    keep = [c for c in asked.columns if c not in keys and c != "t"]
    note = F.struct(*keep).alias("__row")
    none = F.lit(None)
    q = asked.select(*keys, "t", none.cast("int").alias("occ"), none.cast("int").alias("sample"), none.cast("int").alias("win"), note, F.lit(1).alias("__ask"))
    kind = q.schema["__row"].dataType
    seen = events.select(*keys, F.col("i").alias("t"), F.lit(1).alias("occ"), none.cast("int").alias("sample"), none.cast("int").alias("win"))
    known = events.where(F.col("won").isNotNull()).select(
        *keys, (F.col("i") + h).alias("t"), none.cast("int").alias("occ"), F.lit(1).alias("sample"), F.col("won").cast("int").alias("win")
    )
    facts = seen.unionByName(known).select("*", none.cast(kind).alias("__row"), F.lit(0).alias("__ask"))
    order = Window.partitionBy(*keys).orderBy("t", "__ask").rowsBetween(_PAST, 0)
    total = {c: F.coalesce(F.sum(c).over(order), F.lit(0)) for c in ("occ", "sample", "win")}
    return facts.unionByName(q).withColumns(total).where("__ask = 1").select(*keys, "t", *(F.col("__row")[c].alias(c) for c in keep), "occ", "sample", "win")


def bias_value(bias: Column) -> Column:
    return F.when(bias == "bullish", 1.0).when(bias == "bearish", -1.0).otherwise(0.0)


def candle_votes(bars: DataFrame, hits: DataFrame, asked: DataFrame, within: int = 40, h: int = 10, min_samples: int = 5) -> DataFrame:
    """(symbol, i, candles): the three newest candles, each scaled by its pattern's edge as known by bar i.

    ``bars(symbol, ts, i, close)``, ``hits(symbol, i, rank, name, bias)``, ``asked(symbol, i)``.  The edge is the win rate in
    the pattern's direction less the symbol's own base rate, both over outcomes known by then."""
    ret = w.ret("close", w.lag("close", h))
    base = bars.withColumn("__up", F.avg((ret > 0).cast("double")).over(w.history())).select("symbol", F.col("i").alias("t"), "__up")
    after = w.ret(w.lead("close", h), "close")
    out = bars.select("symbol", "i", after.alias("__f"))
    won = F.when(F.col("bias") == "bearish", F.col("__f") < 0).otherwise(F.col("__f") > 0)
    events = hits.join(out, ["symbol", "i"]).withColumn("won", F.when(F.col("__f").isNotNull(), won))
    top = newest_events(asked, hits, 3, within).select("symbol", "t", "name", "bias", "pos")
    x = record_so_far(top, events.select("symbol", "name", "bias", "i", "won"), ["symbol", "name", "bias"], h).join(base, ["symbol", "t"])
    ref = F.when(F.col("bias") == "bearish", 1.0 - F.col("__up")).otherwise(F.col("__up"))
    edge = F.when((F.col("occ") >= min_samples) & (F.col("sample") > 0), w.ratio("win", "sample") - ref)
    size = 0.4 + F.greatest(F.lit(0.0), F.coalesce(edge, F.lit(0.0))) * 2.0
    recent = 1.0 - F.col("pos") * 0.3
    return x.groupBy("symbol", F.col("t").alias("i")).agg(w.ratio(F.sum(bias_value(F.col("bias")) * size * recent), F.sum(recent)).alias("candles"))


def volume_votes(events: DataFrame, asked: DataFrame, within: int = 40) -> DataFrame:
    """(symbol, i, volume): votes of the three newest volume events, of which two dry-ups at most take a place."""
    dry = F.col("name") == "Volume Dry-Up"
    top = newest_events(asked, events.where(~dry), 3, within).unionByName(newest_events(asked, events.where(dry), 2, within))
    spec = Window.partitionBy("symbol", "t").orderBy(F.desc("i"), "rank")
    top = top.withColumn("pos", F.row_number().over(spec)).where("pos <= 3")
    # fixed values: votes of the volume events
    vote = (
        F.when(F.col("name") == "Breakout on Volume", 0.6)
        .when(F.col("name") == "Breakdown on Volume", -0.6)
        .when(F.col("name") == "Volume Spike", F.when(F.col("bias") == "bullish", 0.2).otherwise(-0.2))
        .otherwise(0.0)
    )
    return top.groupBy("symbol", F.col("t").alias("i")).agg(F.sum(vote).alias("volume"))
