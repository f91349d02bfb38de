"""Operators for preparing text corpora on Spark; ``queries`` registers them."""
