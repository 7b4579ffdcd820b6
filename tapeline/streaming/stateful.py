"""Keyed jobs on ``transformWithState``: rows in event-time order, typed state, one pass per released slice.

A key's rows may arrive in any order.  They wait in list state until the
watermark has passed them, then go through a pure step function as one sorted
slice; what comes later than that is dropped, as in every watermarked operator.
The step functions carry a small state and are associative over slices: cutting
the same rows otherwise gives the same results, so restarts and batch borders
leave no trace."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession):
    """``transformWithState`` needs a store with column families; other streams keep the session's own."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class Ordered(StatefulProcessor):
    """Rows wait until the watermark passed them and reach ``step`` sorted by time; subclasses hold their own state."""

    #: Names and types of a waiting row; ``ts`` in microseconds comes first.
    PENDING: list[tuple[str, T.DataType]] = [("ts", T.LongType())]
    #: Names that break ties of one time.
    TIES: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", T.StructType([T.StructField(n, t) for n, t in self.PENDING]))
        self.open()

    def open(self) -> None:
        raise NotImplementedError

    def step(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = [n for n, _ in self.PENDING]
        for chunk in rows:
            chunk = chunk.assign(ts=chunk["ts"].astype("datetime64[us]").astype("int64"))
            # Whole numbers with gaps come as floats; the state wants them whole.
            casts = [int if isinstance(t, T.IntegralType) else None for _, t in self.PENDING]
            rows_of = ([_plain(v) for v in r] for r in chunk[names].itertuples(index=False, name=None))
            self.pending.appendList([tuple(c(v) if c and v is not None else v for c, v in zip(casts, r)) for r in rows_of])
        yield from self._release(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._release(key, timerValues)

    def _release(self, key: tuple, timers) -> Iterator[pd.DataFrame]:
        """Everything up to the watermark, and a timer for what has to wait."""
        if not self.pending.exists():
            return
        passed = timers.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.pending.get(), key=lambda r: r[0])
        cut = next((k for k, r in enumerate(rows) if r[0] > passed), len(rows))
        if cut:
            rest = rows[cut:]
            self.pending.put(rest) if rest else self.pending.clear()
            frame = pd.DataFrame(rows[:cut], columns=[n for n, _ in self.PENDING]).sort_values(["ts", *self.TIES], kind="stable", ignore_index=True)
            out = self.step(key, frame)
            if len(out):
                yield out
        if cut < len(rows):
            self.handle.registerTimer(-(-rows[cut][0] // 1000))

    def close(self) -> None:
        pass


def _plain(v):
    """A Python value of a pandas cell; missing ones are None."""
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    return v.item() if isinstance(v, np.generic) else v


# ------------------------------------------------------ recurrences

_BLOCK = 64


def affine_scan(x: np.ndarray, alpha: float, start: float | None) -> np.ndarray:
    """y = y before + alpha * (x - y before); without ``start`` the first value starts it.

    A step is the affine map y -> (1 - alpha) y + alpha x.  Blocks of steps are composed by one triangular product."""
    if not len(x):
        return np.zeros(0)
    out, at = np.empty(len(x)), 0
    if start is None:
        out[0] = start = x[0]
        at = 1
    keep = 1.0 - alpha
    powers = np.subtract.outer(np.arange(_BLOCK), np.arange(_BLOCK))
    weights = np.where(powers >= 0, alpha * keep ** np.maximum(powers, 0), 0.0)
    decay = keep ** np.arange(1, _BLOCK + 1)
    while at < len(x):
        part = x[at : at + _BLOCK]
        n = len(part)
        out[at : at + n] = weights[:n, :n] @ part + decay[:n] * start
        start, at = out[at + n - 1], at + n
    return out


@dataclass
class Series:
    """What a symbol carries from bar to bar; None until it exists."""

    n: int = 0
    ema: float | None = None
    var: float | None = None
    gain: float | None = None
    loss: float | None = None
    gain2: float | None = None
    loss2: float | None = None
    #: The newest closes, as many as the longest mean needs.
    closes: list[float] = field(default_factory=list)
    #: Whether the bar before was a dip, and the open trade.
    go: bool = False
    held: bool = False
    entry: float = 0.0
    since: int = 0


@dataclass(frozen=True)
class Rules:
    span: int = 12
    lam: float = 0.94
    period: int = 14
    # fixed values: the dip rule
    dip_rsi: float = 15.0
    target: float = 0.06
    stop: float = -0.08
    max_bars: int = 12
    warm: int = 210
    fast: int = 5
    slow: int = 200


def _rolling(full: np.ndarray, width: int, m: int) -> np.ndarray:
    """Means of the ``width`` values up to each of the last ``m``; NaN on a short history."""
    out = np.full(m, np.nan)
    if len(full) >= width:
        means = np.lib.stride_tricks.sliding_window_view(full, width).mean(1)[-m:]
        out[m - len(means) :] = means
    return out


def _walk(s: Series, go: np.ndarray, close: np.ndarray, over: np.ndarray, rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """The dip trade as a state machine: it jumps from entry to exit, at most ``max_bars`` bars at a time."""
    held, ret = np.zeros(len(close), bool), np.full(len(close), np.nan)
    starts, at = np.flatnonzero(go), 0
    while at < len(close):
        if not s.held:
            k = np.searchsorted(starts, at)
            if k == len(starts):
                break
            at = int(starts[k])
            s.held, s.entry, s.since = True, float(close[at]), s.n + at
            held[at] = True
            at += 1
            continue
        to = min(len(close), s.since + rules.max_bars + 1 - s.n)
        gain = close[at:to] / s.entry - 1
        leave = over[at:to] | (gain >= rules.target) | (gain <= rules.stop) | (np.arange(at, to) + s.n - s.since >= rules.max_bars)
        k = int(leave.argmax()) if leave.any() else to - at
        held[at : at + k] = True
        if k < to - at:
            ret[at + k] = gain[k]
            s.held = False
        at += min(k + 1, to - at)
    return held, ret


def advance(s: Series, close: np.ndarray, rules: Rules = Rules()) -> dict[str, np.ndarray]:
    """Moves the state over a slice of finished bars and gives each bar's values; ``advance`` of two slices is that of both at once."""
    m = len(close)
    full = np.concatenate([s.closes, close])
    prev = full[len(s.closes) - 1 : -1] if s.n else np.concatenate([[np.nan], close[:-1]])
    first = 0 if s.n else 1
    diff, ok = close - prev, (close > 0) & (prev > 0)
    square = np.where(ok, np.log(np.where(ok, close, 1.0) / np.where(ok, prev, 1.0)) ** 2, 0.0)
    up, down = np.maximum(diff, 0.0), np.maximum(-diff, 0.0)
    out = {"ema": affine_scan(close, 2.0 / (rules.span + 1), s.ema)}
    for name, x, alpha, start in (
        ("ewma_var", square, 1.0 - rules.lam, s.var), ("gain", up, 1.0 / rules.period, s.gain), ("loss", down, 1.0 / rules.period, s.loss),
        ("gain2", up, 0.5, s.gain2), ("loss2", down, 0.5, s.loss2),
    ):
        out[name] = np.concatenate([np.full(first, np.nan), affine_scan(x[first:], alpha, start)])
    i = s.n + np.arange(m)
    g, lo, g2, l2 = (out.pop(k) for k in ("gain", "loss", "gain2", "loss2"))
    with np.errstate(divide="ignore", invalid="ignore"):
        rsi = np.select([(g == 0) & (lo == 0), g == 0, lo == 0], [50.0, 0.0, 100.0], 100 - 100 / (1 + g / lo))
        rsi2 = np.where(l2 != 0, 100 - 100 / (1 + g2 / l2), np.nan)
        dip = (rsi2 < rules.dip_rsi) & (close > _rolling(full, rules.slow, m)) & (i >= rules.warm)
        over = close > _rolling(full, rules.fast, m)
    go = np.concatenate([[s.go], dip[:-1]])
    out["rsi"], out["rsi2"] = np.where(i >= rules.period, rsi, np.nan), rsi2
    out["in_dip"], out["dip_ret"] = _walk(s, go, close, over, rules)
    last = lambda x: None if np.isnan(x[-1]) else float(x[-1])
    s.n, s.ema, s.var, s.gain, s.loss, s.gain2, s.loss2 = s.n + m, last(out["ema"]), last(out["ewma_var"]), last(g), last(lo), last(g2), last(l2)
    s.closes, s.go = full[-rules.slow :].tolist(), bool(dip[-1])
    return out


_LONG, _DOUBLE, _BOOL = T.LongType(), T.DoubleType(), T.BooleanType()
#: The state's columns, in the order of ``Series``.
_SERIES_TYPES = (_LONG, *[_DOUBLE] * 6, T.ArrayType(_DOUBLE), _BOOL, _BOOL, _DOUBLE, _LONG)
_SERIES = T.StructType([T.StructField(f.name, t) for f, t in zip(fields(Series), _SERIES_TYPES, strict=True)])
_ONLINE = "symbol string, ts timestamp, close double, ema double, ewma_var double, rsi double, rsi2 double, in_dip boolean, dip_ret double"


class _Recurrences(Ordered):
    PENDING = [("ts", T.LongType()), ("close", T.DoubleType())]

    def open(self) -> None:
        self.series = self.handle.getValueState("series", _SERIES)

    def step(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        s = Series()
        if self.series.exists():
            s = Series(*self.series.get())
            s.closes = list(s.closes)
        out = advance(s, rows["close"].to_numpy(float))
        self.series.update(tuple(getattr(s, f.name) for f in fields(s)))
        found = pd.DataFrame({"symbol": key[0], "ts": pd.to_datetime(rows["ts"], unit="us"), "close": rows["close"], **out})
        return found.astype({"in_dip": bool})


def online_state(bars: DataFrame, delay: str = "1 hour") -> DataFrame:
    """EMA, EWMA variance, RSI and the dip position of each finished bar, carried per symbol.

    Columns: symbol, ts, close, ema, ewma_var, rsi, rsi2, in_dip (in the dip trade after the bar), dip_ret (of a trade closed on
    it).  A bar appears once the watermark, ``delay`` behind the newest bar, has passed it; later ones are dropped."""
    x = bars.select("symbol", "ts", "close").withWatermark("ts", delay)
    out = x.groupBy("symbol").transformWithStateInPandas(_Recurrences(), _ONLINE, "append", "eventTime")
    missing = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("ema", "ewma_var", "rsi", "rsi2", "dip_ret")]
    return out.select("symbol", "ts", "close", *missing[:4], "in_dip", missing[4])


# ------------------------------------------------------ alerts

#: A snapshot's facts, in the order of the state; a rule row has the last four instead.
FACTS = [("rsi", T.DoubleType()), ("close", T.DoubleType()), ("confidence", T.DoubleType()), ("verdict", T.StringType()), ("passes", T.BooleanType()), ("stage", T.LongType()), ("cross", T.StringType())]
_RULE = [("rule_id", T.StringType()), ("type", T.StringType()), ("value", T.DoubleType()), ("until", T.LongType())]


def truth(kind: str, value: float | None, x: pd.DataFrame) -> np.ndarray:
    """Whether a rule's condition holds on each snapshot; what is not known does not hold."""
    number = lambda c: x[c].to_numpy(float, na_value=np.nan)
    v = np.nan if value is None else value
    with np.errstate(invalid="ignore"):
        if kind in ("rsi_below", "price_below"):
            return number("rsi" if kind == "rsi_below" else "close") < v
        if kind in ("rsi_above", "price_above", "confidence_above"):
            return number({"rsi_above": "rsi", "price_above": "close", "confidence_above": "confidence"}[kind]) > v
        if kind == "stage2":
            return (x["passes"].map(bool, na_action="ignore") == True).to_numpy() | (number("stage") == 2)  # noqa: E712
    wanted = {"verdict_buy": ("verdict", "BUY"), "verdict_sell": ("verdict", "SELL"), "golden": ("cross", "golden"), "death": ("cross", "death")}
    if kind not in wanted:
        return np.zeros(len(x), bool)
    column, text = wanted[kind]
    return (x[column] == text).to_numpy()


class _Alerts(Ordered):
    PENDING = [("ts", T.LongType()), ("kind", T.IntegerType()), *_RULE, *FACTS]
    TIES = ["kind"]

    def open(self) -> None:
        self.rules = self.handle.getMapState("rules", T.StructType([_field("rule_id", T.StringType())]), T.StructType([*(_field(n, t) for n, t in _RULE[1:]), _field("was", T.BooleanType())]))

    def step(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rules = {k[0]: list(v) for k, v in self.rules.iterator()}
        before = {k: tuple(v) for k, v in rules.items()}
        found = []
        # Between two changes of the rules every rule sees one stretch of snapshots.
        change = (rows["kind"] == 0).to_numpy()
        stretch = np.cumsum(change)
        for _, part in rows.groupby(stretch, sort=True):
            head = part.iloc[0]
            if head["kind"] == 0:
                rules.pop(head["rule_id"], None)
                until = _plain(head["until"])
                if until is None or until > head["ts"]:
                    rules[head["rule_id"]] = [head["type"], _plain(head["value"]), None if until is None else int(until), False]
                part = part.iloc[1:]
            if not len(part):
                continue
            for name, rule in list(rules.items()):
                kind, value, until, was = rule
                live = np.ones(len(part), bool) if until is None else part["ts"].to_numpy() < until
                now = truth(kind, value, part) & live
                fired = now & ~np.concatenate([[was], now[:-1]])
                found += [(name, key[0], kind, int(part["ts"].iloc[k]), _plain(part["close"].iloc[k])) for k in np.flatnonzero(fired)]
                rule[3] = bool(now[-1])
                if not live[-1]:
                    del rules[name]
        for name in before.keys() - rules.keys():
            self.rules.removeKey((name,))
        for name, rule in rules.items():
            if before.get(name) != tuple(rule):
                self.rules.updateValue((name,), tuple(rule))
        out = pd.DataFrame(found, columns=["rule_id", "symbol", "type", "ts", "close"])
        return out.assign(ts=pd.to_datetime(out["ts"], unit="us"), close=out["close"].astype(float))


def _field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind)


def stream_alerts(snapshots: DataFrame, rules: DataFrame, delay: str = "1 day") -> DataFrame:
    """Rules of ten types that fire once when their condition turns true.

    ``snapshots``: symbol, ts and FACTS.  ``rules``, a stream of its own: rule_id, symbol, ts, type, value, until.  A rule
    counts from its row on (a snapshot of the same time included) to ``until`` (NULL: for good) and is then forgotten;
    a later row of its id replaces it, which starts anew.  State per symbol: each live rule with its last truth.  Rows more than
    ``delay`` behind the newest one of either stream are dropped."""
    none = lambda pairs: [F.lit(None).cast(t).alias(n) for n, t in pairs]
    until = F.unix_micros("until").alias("until")
    a = rules.select("symbol", "ts", F.lit(0).alias("kind"), "rule_id", "type", F.col("value").cast("double").alias("value"), until, *none(FACTS))
    b = snapshots.select("symbol", "ts", F.lit(1).alias("kind"), *none(_RULE), *(F.col(n).cast(t).alias(n) for n, t in FACTS))
    # One watermark behind both: quiet rules must not hold the snapshots back.
    x = a.union(b).withWatermark("ts", delay)
    return x.groupBy("symbol").transformWithStateInPandas(_Alerts(), "rule_id string, symbol string, type string, ts timestamp, close double", "append", "eventTime")
