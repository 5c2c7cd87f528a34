"""Readers and writers for CSV trees, JSON documents and parquet artifacts."""
