"""Operators on rows: aggregation, additivity, windows over results, time, and the plain relational ones."""
