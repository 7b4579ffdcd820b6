"""What a user plugs in: a mask, a transition; and the tables that studies and ledgers are published to."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..operators import ledger as L
from ..operators import masks as M
from ..operators import replay as R
from ..operators import study as S
from ..operators import trades as TR
from ..session import fresh_dir
from ..sources import snapshots as SN
from . import ledger as PL
from . import panels as P
from . import posture as PP
from .registry import QUERIES, query
from .studies import FEAT, features, long_sql, summary_sql
from .trades import DIP

_USER = {"user_quiet_high": "close > prior50 AND vr < 0.8 AND enough", "user_deep_quiet": "dd <= -0.2 AND vr < 0.8"}


@query("user_mask_study", "U1", P.with_(*FEAT, *long_sql(list(_USER), (21, 63), "f3", masks=_USER), recursive=True) + summary_sql())
def user_mask_study(spark, d):
    """Two masks of a user's own through the study harness."""
    M.register("user_quiet_high", lambda: (F.col("close") > F.col("prior50")) & (F.col("vr") < 0.8) & F.col("enough"))
    M.register("user_deep_quiet", lambda: (F.col("dd") <= -0.2) & (F.col("vr") < 0.8))
    return S.run_study(features(spark, d), M.columns(list(_USER)), (21, 63))


def one_at_a_time(free: int, entries: pd.DataFrame) -> tuple[int, pd.DataFrame]:
    """The transition of a single position: an entry counts once the one before is out; one that never ends blocks the rest."""
    taken = []
    for row, i, held in zip(entries.index, entries["i"], entries["held"]):
        if i > free:
            free = 2**62 if pd.isna(held) else i + int(held)
            taken += [] if pd.isna(held) else [row]
    out = entries.loc[taken, ["symbol", "i", "held", "ret"]]
    return free, out.astype({"held": "int64"})


@query("replay_fold", "U4", P.with_(*DIP, recursive=True) + "SELECT symbol, i, held, ret FROM dt")
def replay_fold(spark, d):
    entries = TR.dip_entries(P.type_px(spark, d))
    reach = F.coalesce(F.col("i") + F.col("held"), F.lit(2**62))
    return R.replay(entries, ["symbol"], ["i"], lambda: -1, one_at_a_time, "symbol string, i long, held long, ret double", reach)


@query("study_sink", "A21", PP.SERIES + "SELECT * FROM pf")
def study_sink(spark, d):
    """Study samples published by year, a year written again, and read back."""
    samples, path = PP.scored(spark, d), fresh_dir(spark, "study_samples")
    SN.replace(samples, path, F.year("ts"))
    SN.replace(samples.where(F.year("ts") == 1997), path, F.year("ts"))
    return SN.read(spark, path, samples.schema)


@query("study_result_sink", "A21", QUERIES["posture_correlations"].sql)
def study_result_sink(spark, d):
    """Study results published whole and read back."""
    result, path = PP.posture_correlations(spark, d), fresh_dir(spark, "study_results")
    SN.replace(result, path)
    return SN.read(spark, path, result.schema)


@query("ledger_published", "A22", P.with_(*PL.V, recursive=True) + f"SELECT {PL.COLS} FROM lg")
def ledger_published(spark, d):
    """Two overlapping appends to a published ledger, read back."""
    calls, path = PL.ledger(spark, d), fresh_dir(spark, "ledger")
    L.append_published(calls.where(F.col("ts") < "1997-03-15"), path)
    L.append_published(calls.where(F.col("ts") >= "1996-11-01"), path)
    return L.read_published(spark, path)
