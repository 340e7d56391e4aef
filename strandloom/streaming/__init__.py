"""Variant files as a stream: files that arrive in a folder become triples as they come."""
