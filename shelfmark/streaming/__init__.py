"""Incremental ingest with the batch cleaning expressions."""
