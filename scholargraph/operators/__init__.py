"""Operators on DataFrames: search, filters, networks, graph analytics, details, tables."""
