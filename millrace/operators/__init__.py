"""Reads over a mutation log: resolution, lookups, scans, merges and counters."""
