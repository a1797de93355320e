"""Operators for building training data from text tables, and the queries that apply them."""
