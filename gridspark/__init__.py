"""Gridded-field analytics on Spark DataFrames."""
