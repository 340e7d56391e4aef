"""Operators over tables: explosion, triples, dictionary encoding, metrics."""
