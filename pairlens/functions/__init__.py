"""Column expressions: canonical text, rounding within a tolerance, numeric parsing."""
