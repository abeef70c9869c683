"""Intervention (event-study) analysis on operational event logs, on Spark DataFrames."""

__version__ = "0.1.0"
