"""Compositions of operators: full and incremental refresh, endpoints, publication."""
