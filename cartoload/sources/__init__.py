"""Partitioned scans, one module per source kind."""
