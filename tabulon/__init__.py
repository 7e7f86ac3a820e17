"""Profiling, cleaning, statistics and chart data for Spark DataFrames."""

from tabulon.errors import AnalysisError

__all__ = ["AnalysisError"]
