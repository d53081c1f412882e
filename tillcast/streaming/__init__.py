"""Structured Streaming ingestion of landed transaction-log files."""
