"""Spark operators for pipelines that join daily price bars with news text."""

__version__ = "0.1.0"
