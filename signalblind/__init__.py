"""Controlled-signal analytics on Spark DataFrames."""
