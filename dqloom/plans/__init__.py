"""Declared suites, star schema, strategies and experiment plans."""
