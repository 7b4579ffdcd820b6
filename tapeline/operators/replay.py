"""Stateful replay with a user's transition.

A fold needs the rows of a key in order, but not all at once: rows are sorted
inside their partition (Spark spills), handed over in Arrow batches, and only the
user's state goes from batch to batch.  Where the caller can say how far a row
reaches, a key is cut into islands, runs of rows that can touch each other, and
islands spread over tasks; an island that is the whole key is still read batch by
batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ISLAND = "__island"
Step = Callable[[Any, pd.DataFrame], tuple[Any, pd.DataFrame | None]]


def with_islands(rows: DataFrame, keys: Sequence[str], order: str, reach: Column) -> DataFrame:
    """Numbers the islands of each key: a row past the reach of all rows before it begins one."""
    w = Window.partitionBy(*keys).orderBy(order)
    x = rows.withColumn("__past", F.max(reach).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    begins = F.coalesce((F.col(order) > F.col("__past")).cast("int"), F.lit(0))
    return x.withColumn(ISLAND, F.sum(begins).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__past")


def replay(rows: DataFrame, keys: Sequence[str], order: Sequence[str], start: Callable[[], Any], step: Step, schema: str, reach: Column | None = None) -> DataFrame:
    """Folds each key's rows in ``order``; ``step(state, rows)`` gives the next state and the rows to put out (``schema``, or None).

    ``step`` may get a key in any number of consecutive pieces, so it has to give the same result however they are cut.  With
    ``reach`` (how far a row reaches, on the scale of the one order column) every island starts from a fresh state.  Null keys are
    a key like any other; rows that tie in ``order`` come in any order."""
    x, by = rows, list(keys)
    if reach is not None:
        x, by = with_islands(rows, keys, order[0], reach), [*keys, ISLAND]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for batch in batches:
            if not len(batch):
                continue
            cells = batch[by]
            # Nulls compare equal here, as keys do.
            new = ~((cells == cells.shift()) | (cells.isna() & cells.shift().isna())).all(axis=1)
            for _, part in batch.groupby(new.cumsum(), sort=False):
                key = tuple(None if pd.isna(v) else v for v in part[by].iloc[0])
                if now is None or key != now[0]:
                    now, state = (key,), start()
                state, out = step(state, part)
                if out is not None and len(out):
                    yield out

    return x.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(run, schema)
