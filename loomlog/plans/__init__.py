"""Whole jobs composed from the operators: reports, guarded rewrites, adapters."""
