"""Functions of the workload diagnostics library."""
