"""Temporal feature analytics on Spark."""
