"""Iterative fits: one Spark job per step, K rows back to the driver."""
