"""Spark-native engine for tables of points, paths and graphs."""

__version__ = "0.1.0"
