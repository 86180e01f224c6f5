"""Incremental counts over a stream of interactions."""
