"""tapeline: market-series analytics and event studies as Spark DataFrame operators."""

__all__ = ["functions", "sources", "operators", "plans", "streaming"]
