"""Spark jobs for text corpora, vector search, evaluation, training books and telemetry."""

__version__ = "0.1.0"
