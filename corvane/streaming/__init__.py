"""Structured Streaming: ingest into an index, and windows over event time."""
