"""Spark-first reversible text privacy: detect, decide, mask and restore over DataFrames."""

__version__ = "0.1.0"
