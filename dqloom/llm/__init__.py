"""Operators for large text corpora, each with its own module; ``queries`` registers them."""
