"""Readers and adapters: CSV transaction logs, the landing-zone file gate, ERP sheet rows, Parquet tables and the TPC-H-style driver tables."""
