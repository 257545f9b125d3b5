"""Contextlake: text compaction and retrieval operators for Spark tables."""
