"""Readers and writers: JSON lines, CSV, Parquet tables and filter documents."""
