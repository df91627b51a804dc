"""Foliant: a PySpark-native document-processing and corpus-analytics engine."""

__version__ = "0.1.0"
