"""Relational operators: chunking, change detection, trees, retention, garbage collection and keyed tables."""
