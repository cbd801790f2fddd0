"""Ledgerline: a PySpark-native data-quality audit engine for wide operational tables."""

__version__ = "0.1.0"
