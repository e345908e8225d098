"""Operators for training-data pipelines over document tables. Nothing else in the package imports this folder."""
