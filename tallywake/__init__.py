"""Spark jobs over software-change and developer-tool data."""
