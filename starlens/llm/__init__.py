"""Operators for training-data pipelines, with their queries in ``catalog``."""
