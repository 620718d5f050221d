"""Segtide: exact weighted-edit-distance segment search on Spark DataFrames."""

__version__ = "0.1.0"
