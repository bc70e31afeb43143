"""A PySpark-native analytics engine for auction and resale-market data."""

__version__ = "0.1.0"
