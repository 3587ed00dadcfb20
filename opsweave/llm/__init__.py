"""Operators for training-data pipelines, one module each; nothing outside imports this package."""
