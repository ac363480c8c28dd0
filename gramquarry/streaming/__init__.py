"""Incremental indexing of streams."""
