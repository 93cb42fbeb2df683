"""Operators of the workload diagnostics library."""
