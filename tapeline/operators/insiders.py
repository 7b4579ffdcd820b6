"""Insider transactions rolled up per issuer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LOOKBACK_DAYS = 90
CLUSTER = 3
NAMES = 6
# fixed values: title words of top executives; routine transaction codes
TOP_TITLES = "ceo|cfo|chief|president|chairman"
ROUTINE = ["A", "M", "F", "G"]


def recent(tx: DataFrame, days: int = LOOKBACK_DAYS) -> DataFrame:
    """Transactions of the last ``days`` before the newest one."""
    newest = tx.agg(F.max("ts")).scalar()
    return tx.where(F.col("ts") >= newest - F.expr(f"INTERVAL {days} DAYS"))


def summary(tx: DataFrame) -> DataFrame:
    """Buys, sells and routine filings per issuer.  Everything is a partial
    aggregate; the few names shown come from a ranked distinct list."""
    aggs = []
    for code, n in (("P", "buy"), ("S", "sell")):
        on = F.col("code") == code
        aggs += [
            F.count(F.when(on, 1)).alias(f"n_{n}"),
            F.count_distinct(F.when(on, F.col("owner"))).alias(f"{n}_people"),
            F.coalesce(F.sum(F.when(on, F.col("shares"))), F.lit(0.0)).alias(f"{n}_shares"),
            F.coalesce(F.sum(F.when(on, F.col("shares") * F.col("price"))), F.lit(0.0)).alias(f"{n}_value"),
            F.avg(F.when(on & (F.col("price") > 0), F.col("price"))).alias(f"{n}_avg_price"),
            F.coalesce(F.max(F.when(on, F.lower("role").rlike(TOP_TITLES))), F.lit(False)).alias(f"{n}_csuite"),
        ]
    g = tx.groupBy("issuer").agg(*aggs, F.count(F.when(F.col("code").isin(ROUTINE), 1)).alias("n_routine"))
    spec = Window.partitionBy("issuer").orderBy("owner")
    who = tx.where(F.col("code") == "P").select("issuer", "owner").distinct()
    who = who.withColumn("__k", F.row_number().over(spec)).where(F.col("__k") <= NAMES)
    who = who.groupBy("issuer").agg(F.array_join(F.array_sort(F.collect_list("owner")), ",").alias("buy_names"))
    bw = F.when(F.col("buy_value") > 0, F.col("buy_value")).otherwise(F.col("buy_shares"))
    sw = F.when(F.col("sell_value") > 0, F.col("sell_value")).otherwise(F.col("sell_shares"))
    return g.join(who, "issuer", "left").withColumns(
        {
            "cluster_buy": (F.col("buy_people") >= CLUSTER) & (F.col("buy_shares") > 0),
            "signal": F.when((bw > 0) & (bw >= sw), "buying").when((sw > 0) & (sw > bw), "selling").otherwise("routine"),
        }
    )
