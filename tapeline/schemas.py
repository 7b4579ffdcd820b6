"""Declared schemas of the data model and the check every operator entry uses."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_D, _S, _TS, _L, _B = T.DoubleType(), T.StringType(), T.TimestampType(), T.LongType(), T.BooleanType()


def _schema(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


TRADES = _schema(("symbol", _S, False), ("ts", _TS, False), ("price", _D, True), ("qty", _D, True))
BARS = _schema(
    ("symbol", _S, False),
    ("ts", _TS, False),
    ("open", _D, False),
    ("high", _D, False),
    ("low", _D, False),
    ("close", _D, False),
    ("volume", _D, True),
)
CLOSES = _schema(("symbol", _S, False), ("ts", _TS, False), ("close", _D, False))
SIGNAL_EVENTS = _schema(
    ("symbol", _S, False),
    ("ts", _TS, False),
    ("category", _S, False),
    ("name", _S, False),
    ("bias", _S, False),
    ("strength", _D, False),
)
HOLDINGS = _schema(("account", _S, False), ("symbol", _S, False), ("shares", _D, False), ("avg_cost", _D, True))
ACCOUNTS = _schema(("account", _S, False), ("cash", _D, False))
FUND_HOLDINGS = _schema(("fund", _S, False), ("underlying", _S, False), ("weight", _D, False))
INSIDER_TX = _schema(
    ("issuer", _S, False),
    ("code", _S, False),
    ("shares", _D, True),
    ("price", _D, True),
    ("ad", _S, True),
    ("owner", _S, False),
    ("role", _S, True),
)
LEDGER = _schema(
    ("ts", _TS, False),
    ("symbol", _S, False),
    ("signal_type", _S, False),
    ("direction", _S, False),
    ("predicted_p", _D, True),
    ("entry_price", _D, True),
    ("note", _S, True),
)


class SchemaError(ValueError):
    pass


def require(df: DataFrame, schema: T.StructType | Iterable[str], what: str = "input") -> DataFrame:
    """Fail at plan time when a column is missing or has another type."""
    have = {f.name: f.dataType for f in df.schema.fields}
    if isinstance(schema, T.StructType):
        for f in schema.fields:
            if f.name not in have:
                raise SchemaError(f"{what}: column {f.name} is missing")
            if have[f.name] != f.dataType:
                raise SchemaError(
                    f"{what}: column {f.name} is {have[f.name].simpleString()}, "
                    f"expected {f.dataType.simpleString()}"
                )
    else:
        for name in schema:
            if name not in have:
                raise SchemaError(f"{what}: column {name} is missing")
    return df
