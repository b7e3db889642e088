"""Interval, sequence, cache and lifecycle analytics on Spark DataFrames."""
