"""Dialogue retrieval and scene assembly on Spark."""
