"""Incremental ingest of JSON drops."""
