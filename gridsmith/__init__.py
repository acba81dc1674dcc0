"""Spark-native toolkit for profiling, cleaning, sampling and combining tabular data."""

__version__ = "0.1.0"
