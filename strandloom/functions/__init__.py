"""Scalar functions: Column expressions and driver-side helpers."""
