"""Readers and writers: parquet tables, quarantine files, topology tables, result files."""
