"""Sources of the workload diagnostics library."""
