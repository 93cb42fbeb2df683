"""Workload diagnostics on Spark: database activity captures to ranked, evidence-backed findings."""
