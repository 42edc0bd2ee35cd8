"""Basaltic: source-code and dependency analytics as Spark DataFrames."""

__version__ = "0.1.0"
