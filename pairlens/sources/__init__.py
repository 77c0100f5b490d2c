"""Inputs of any supported format as DataFrames, and writers of results."""
