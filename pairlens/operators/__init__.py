"""Relational operators of the comparison: alignment, differences, duplicates, schema, profiles, rules."""
