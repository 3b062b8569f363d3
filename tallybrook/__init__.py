"""Profiling, sketching and sampling of record data on Spark DataFrames."""
