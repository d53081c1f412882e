"""Registered queries, their DuckDB oracle SQL, and the batch ingest job."""
