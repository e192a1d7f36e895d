"""Hybrid document search and index building as Spark DataFrame transformations."""
