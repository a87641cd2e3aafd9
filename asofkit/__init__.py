"""Prequential feature analytics over event logs, on Spark DataFrames."""
