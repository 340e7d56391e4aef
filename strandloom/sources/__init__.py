"""Readers: variant files, tables, N-Triples and metrics."""
