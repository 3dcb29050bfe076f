"""Similarity grouping and corpus preparation on Spark DataFrames."""
