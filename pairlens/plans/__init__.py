"""Whole comparisons: configuration, results, many pairs, hooks."""
