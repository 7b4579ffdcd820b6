"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import as_table


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _star(links: DataFrame, both: bool) -> DataFrame:
    """Large star (``both``): larger neighbours move to a node's smallest neighbour;
    small star: a node and its smaller neighbours do."""
    small, large = F.least("a", "b"), F.greatest("a", "b")
    near = links.select(large.alias("u"), small.alias("v"))
    if both:
        near = near.union(links.select(small.alias("u"), large.alias("v")))
    low = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    moved = near.join(low, "u")
    if both:
        moved = moved.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` of two longs -> ``(node, root)``: every linked node and the smallest node of its component.

    Each round is written to the shared folder, so no lineage grows and a lost
    executor repeats one round.  Only a count and a checksum reach the driver.
    Rows with a null end and self links are ignored; no links, no rows."""
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = as_table(links, "links")
    state = _state(links)
    while state[0]:
        links = as_table(_star(_star(links, True), False), "links")
        now = _state(links)
        if now == state:
            break
        state = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
