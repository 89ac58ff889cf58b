"""Operators for large training-text pipelines, each a Spark job on the document tables."""
