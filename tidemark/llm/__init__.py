"""Operators for building training data from a text corpus, and the queries that apply them."""
