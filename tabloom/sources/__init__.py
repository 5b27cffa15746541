"""Readers and writers over Spark's own sources."""
