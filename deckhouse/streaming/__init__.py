"""Incremental ingest of a growing library."""
