"""Hybrid retrieval and usage analytics over append-only text logs, on Spark."""
