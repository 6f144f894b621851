"""DataFrame operators over staging tables and the load catalogue."""
