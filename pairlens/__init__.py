"""Comparison of two versions of a dataset, and data-quality metrics, as Spark DataFrames."""
