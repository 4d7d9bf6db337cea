"""Incremental snapshots from a stream of files."""
