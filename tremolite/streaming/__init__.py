"""Structured Streaming versions of ingest, windows, alarms and matches."""
