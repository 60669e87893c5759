"""Readers: Parquet tables, pipe-delimited tables, update sets."""
