"""Recommendation analytics on PySpark DataFrames."""
