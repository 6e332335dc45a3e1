"""Incremental processing of newly arrived batches."""
