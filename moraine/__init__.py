"""Snapshot analytics on Spark: incremental, de-duplicating, content-addressed snapshots as DataFrame operations."""
