"""Declarative mappings: their parser, their compiler, and the driver's queries."""
