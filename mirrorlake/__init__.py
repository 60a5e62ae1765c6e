"""Duplicate and change analytics on Spark DataFrames."""
