"""Spark-native analytics over source-code comments: lexing, task markers, authors, reports."""

__version__ = "0.1.0"
