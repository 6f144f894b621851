"""Whole jobs: the load run, and the registered queries by area."""
