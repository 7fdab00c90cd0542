"""Incremental builds as streams."""
