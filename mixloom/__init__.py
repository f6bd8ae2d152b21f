"""Mixture-of-Gaussians clustering and its data preparation on Spark."""
