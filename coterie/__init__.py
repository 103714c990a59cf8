"""Frequent-pattern analytics on Spark DataFrames."""
