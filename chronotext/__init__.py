"""Timed-text analytics on Spark: words, segments and cues as DataFrames."""

__version__ = "0.1.0"
