"""Registered queries, grouped by area; importing the modules registers them."""

from . import ingest, indicators, volatility, candles, studies, regimes, levels, trades, patterns, crosssection, evaluations, portfolio, ledger, feeds, composites, forecast, posture, streaming, scale, extensions  # noqa: F401
from .registry import QUERIES

__all__ = ["QUERIES"]
