"""Plans of the workload diagnostics library."""
