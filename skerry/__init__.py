"""Operational analytics on Spark DataFrames."""
