"""Earnings-document intelligence on Spark: DataFrames in, DataFrames out."""
