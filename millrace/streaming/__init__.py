"""Continuous ingestion of mutation logs."""
